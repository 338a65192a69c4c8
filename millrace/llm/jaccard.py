"""Self-join of documents by Jaccard similarity of their sets of five-word shingles, with Bayesian pruning.

1. Texts with equal shingle sets form a class; its id is the smallest doc_id. Classes are compared, not copies.
2. MinHash values in BANDS bands of ROWS propose: classes that share a band's key get into one group (components
   over the keys' hubs). A pair of similarity 0.8 shares no band with probability 8e-5, one of 0.9 with 5e-12.
3. Within a group, blocks of classes are compared with blocks: MinHash values are compared STEP at a time, and a
   pair is dropped when the posterior probability (uniform prior) that its similarity reaches the threshold falls
   below TOLERANCE. All other pairs are verified on the sets themselves.
4. Links are counted where they are found and joined to roots; components run over the roots.

Words are maximal runs of characters other than space and U+0009 to U+000D; a text of one to four words has one
shingle, all its words. Defined results: null and empty texts have no shingles, hence no links, and each is its
own class; rows without doc_id are in no class (class_id null, no links, kept); rows that share a doc_id are one document:
equal ones count once, different texts are compared like those of different documents, and classes that have the same
smallest doc_id get each other's links added; other columns aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.blocks import block_pairs, by_group, linked
from millrace.llm.common import saved, spread
from millrace.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)
BANDS, ROWS = 40, 7
STEP = 40
TOLERANCE = 1e-9
#: Classes in a block.
BLOCK = 400
CHUNK_BYTES = 2_000_000
SEED = 7

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def fmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(texts: list, most: int = CHUNK_BYTES):
    """Slices of texts of about most characters."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= most):
            size += len(texts[b] or "")
            b += 1
        yield a, b
        a = b


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    flat, counts = [], []
    for t in texts:
        # splits at space and U+0009 to U+000D alone, as bytes
        ws = (t or "").encode().split()
        counts.append(len(ws))
        flat += ws
    if not flat:
        return [np.empty(0, np.uint64) for _ in texts]
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    del flat
    distinct = coded.dictionary.to_pylist()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]
    padded = np.concatenate([w, np.zeros(SHINGLE, np.uint64)])
    g = fmix(sum(padded[k : k + len(w)] * _MIX[k] for k in range(SHINGLE)))
    out, a = [], 0
    for n in counts:
        if n >= SHINGLE:
            s = np.sort(g[a : a + n - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            short = np.zeros(SHINGLE, np.uint64)
            short[:n] = w[a : a + n]
            out.append(fmix(sum(short[k : k + 1] * _MIX[k] for k in range(SHINGLE)) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        a += n
    return out


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return r.integers(0, 1 << 31, n, np.uint32)[:, None] * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)[:, None]


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes that isn't empty."""
    a, b = _functions()
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = None
    for k in range(0, len(x), 2048):
        v = a * x[None, k : k + 2048]
        v += b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        low = v.min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    rows = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    mixed = sum(rows[:, :, k] * _MIX[k] for k in range(ROWS)) + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x2545F4914F6CDD1D)
    return fmix(mixed).view(np.int64)


def class_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


@lru_cache(maxsize=4)
def fewest_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Matches that a pair must have after n comparisons, else its similarity reaches the threshold with a posterior
    probability below tolerance. With a uniform prior that probability after m of n is P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        p, m = 0.0, 0
        while True:
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left x right, or within left if right is None) of similarity at least the threshold."""
    num, den = THRESHOLD
    sigs = np.stack([signature(s) for s in sets])
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    need = fewest_matches(num / den, TOLERANCE)
    cols = left if right is None else right
    found_a, found_b = [], []
    for a in range(0, len(left), 128):
        rows = left[a : a + 128]
        ok = (np.minimum(size[rows][:, None], size[cols][None]) * den >= num * np.maximum(size[rows][:, None], size[cols][None]))
        if right is None:
            ok &= rows[:, None] < cols[None]
        ii, jj = np.nonzero(ok)
        ii, jj = rows[ii], cols[jj]
        match = np.zeros(len(ii), np.int64)
        for n in range(STEP, BANDS * ROWS + 1, STEP):
            if not len(ii):
                break
            for part in range(0, len(ii), 1 << 16):
                p = slice(part, part + (1 << 16))
                match[p] += (sigs[ii[p], n - STEP : n] == sigs[jj[p], n - STEP : n]).sum(axis=1)
            alive = match >= need[n]
            ii, jj, match = ii[alive], jj[alive], match[alive]
        if len(ii):
            common = intersections(sets, ii, jj)
            good = common * (num + den) >= num * (size[ii] + size[jj])
            found_a.append(ii[good])
            found_b.append(jj[good])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def intersections(sets: list[np.ndarray], ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
    """Sizes of the exact intersections of sets ii with sets jj."""
    if len(ii) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(ii, jj, strict=True)], np.int64)
    rows, ri = np.unique(ii, return_inverse=True)
    cols, ci = np.unique(jj, return_inverse=True)
    used = np.union1d(rows, cols)
    values, inverse, n = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    number = np.full(len(values), -1, np.int64)
    number[shared] = np.arange(len(shared))
    bounds = np.concatenate([[0], np.cumsum([len(sets[k]) for k in used])])
    total = np.zeros((len(rows), len(cols)), np.float32)
    at_r, at_c = np.searchsorted(used, rows), np.searchsorted(used, cols)
    coded = number[inverse]
    owner = np.repeat(np.arange(len(used)), np.diff(bounds))
    coded, owner = coded[coded >= 0], owner[coded >= 0]
    order = np.argsort(coded, kind="stable")
    coded, owner = coded[order], owner[order]
    width = 4096
    for a in range(0, len(shared), width):
        p = slice(*np.searchsorted(coded, [a, a + width]))
        dense = np.zeros((len(used), width), np.float32)
        dense[owner[p], coded[p] - a] = 1
        total += dense[at_r] @ dense[at_c].T
    return total[ri, ci].astype(np.int64)


def _compare(group: pd.DataFrame) -> pd.DataFrame | None:
    if len(group) < 2:
        return None
    # rows that share doc_id and text are one
    group = group[~group.duplicated(["id", "c1"]).to_numpy()].reset_index(drop=True)
    sets = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
    own, ids, weight = group["own"].to_numpy(), group["id"].to_numpy(), group["n"].to_numpy()
    i, j = group["i"].iloc[0], group["j"].iloc[0]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    a, b = similar_pairs(sets, left, None if i == j else right)
    return linked(ids, weight, a, b)


def similarity_join(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept): one row a document. n_links: other documents linked directly."""
    return _joined(df, text).drop("h")


def _joined(df: DataFrame, text: str) -> DataFrame:
    """similarity_join with h, a hash of the row's text."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))

    def sign(batches):
        for pdf in batches:
            texts, out = pdf["t"].tolist(), []
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b])
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, band_keys(np.stack([signature(sets[k]) for k in full])), strict=True):
                        keys[k] = row
                out += [(*(class_key(s) if len(s) else (None, None)), k) for s, k in zip(sets, keys, strict=True)]
            # whole numbers with nulls: as floats they would lose digits
            halves = [pd.array([x[k] for x in out], "Int64") for k in (0, 1)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "h": pdf["h"].to_numpy(), "c1": halves[0], "c2": halves[1], "bands": [x[2] for x in out]})

    signed = saved(spread(docs).where("doc_id is not null").withColumn("h", F.xxhash64("t")).mapInPandas(sign, "doc_id long, h long, c1 long, c2 long, bands array<long>"), "signed")
    classes = saved(
        signed.where("c1 is not null").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "bands")).alias("m"), F.count_distinct("doc_id").alias("n")).select("c1", "c2", "n", F.col("m.doc_id").alias("id"), F.col("m.bands").alias("bands")),
        "classes",
    )
    keyed = classes.select("id", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub != last").select("key", "hub")
    groups = saved(components(keyed.join(hubs, "key").select(F.col("id").alias("a"), F.col("hub").alias("b"))), "groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    asked = groups.join(sizes, "component").join(classes.select("c1", "c2", "n", "id"), "id")

    def sets_of(batches):
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in chunks(texts):
                part = pdf.iloc[a:b]
                sets = shingle_sets(texts[a:b])
                same = [len(s) > 0 and class_key(s) == (x, y) for s, x, y in zip(sets, part["c1"], part["c2"], strict=True)]
                yield part[["component", "size", "id", "n", "c1"]].assign(shingles=[s.tobytes() for s in sets])[same]

    with_sets = docs.join(asked, docs["doc_id"] == asked["id"]).select("component", "size", "id", "n", "c1", "c2", "t").mapInPandas(sets_of, "component long, size long, id long, n long, c1 long, shingles binary")
    found = saved(by_group(block_pairs(with_sets, "size", "id", BLOCK), ["component", "i", "j"], _compare, "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("c1", "c2", "n", "id").join(links, "id", "left").join(roots, "id", "left")
    named = signed.select("doc_id", "h", "c1", "c2").join(of_class, ["c1", "c2"], "left").select(
        "doc_id",
        "h",
        F.coalesce("id", "doc_id").alias("class_id"),
        (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "id", "doc_id").alias("component_id"),
    )
    nameless = docs.where("doc_id is null").select("doc_id", F.xxhash64("t").alias("h"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return named.union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(df: DataFrame, text: str = "text") -> DataFrame:
    """df's rows without the documents whose component has a smaller doc_id; of rows that share doc_id and text one
    stays."""
    kept = _joined(df, text).where("kept and doc_id is not null").select("doc_id", "h").distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = df.where("doc_id is not null").select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    one = rows.join(kept, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return one.select("row.*").union(df.where("doc_id is null"))
