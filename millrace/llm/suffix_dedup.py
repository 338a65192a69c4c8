"""Removal of byte strings that occur more than once in a corpus, by suffix arrays over shards.

A window is a string of WINDOW bytes that starts at some byte of a document; a byte goes if a window that covers it
also starts anywhere else. To put equal windows in one shard, each window is led by its smallest hashed GRAM-byte
string (leftmost on ties): equal windows have equal leaders. The windows of a document that share one leading string
are a run; a run's bytes are a piece.

1. scan: hashes, bytes and runs of every text. Copies of whole texts are counted, one of each goes on.
2. A leader that leads one run in the whole corpus leads no repeat; only the other runs are cut into pieces. Runs
   whose leader is frequent are cut again by the bytes around it, so that pieces meet only if 176 of their bytes are
   equal. Equal pieces of a task are shipped once.
3. Pieces are dealt to shards by leader. A shard's distinct pieces are laid end to end, suffix-sorted by
   Larsson-Sadakane refinement (only groups that aren't yet sorted are sorted again, by the ranks twice as far on),
   given common prefixes by Kasai's algorithm, and grouped where neighbours share WINDOW bytes. A leader whose pieces
   exceed a shard gets several, which are merged by binary search of each one's windows among the other's.
4. Repeated windows return to their documents by piece, and the bytes that they cover are removed.

Defined results: null is the empty text; texts shorter than WINDOW lose nothing; a text that occurs twice loses every
byte if it has WINDOW bytes; rows without doc_id and rows that share one are documents of their own; an empty table
gives an empty table; other columns pass through where texts are returned. A text whose bytes are cut within a
character loses the rest of that character too (in texts, not in digests).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import drop_table, saved, spread

WINDOW = 200
GRAM = 64
#: Bytes of pieces in a shard.
SHARD = 1 << 18
#: Runs of a leader from which on its runs are cut again.
FREQUENT = 5000
CUT = 25
#: Bytes of text that are scanned at once, and bytes of pieces among which a task looks for equal ones.
SCAN = 1 << 16
COMBINE = 8 << 20
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_at(text: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from every position as an integer; beyond the end are zeros."""
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    out = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = padded[r : r + (n + 15 - r) // 8 * 8].view(f"{order}u8")
        out[r::8] = part[: len(out[r::8])]
    return out


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position that has as many."""
    h = words_at(text)[: len(text)]
    size = 8
    for k in range(3):
        h = h[:-size] * _K[0] + (h[size:] ^ (h[size:] >> np.uint64(29))) * _K[k + 1]
        h ^= h >> np.uint64(32)
        size *= 2
    h *= _K[2]
    return (h ^ (h >> np.uint64(31)))[: len(text) - GRAM + 1]


def runs(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leader, first window, place of the leader) of each run in texts that lie end to end, up to ends."""
    n = len(text)
    empty = np.empty(0, np.int64)
    if n < WINDOW:
        return np.empty(0, np.uint64), empty, empty
    h = gram_hashes(text)
    w = WINDOW - GRAM + 1
    bits = np.uint64(24)  # a scan is shorter than 1 << 24 bytes
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(v) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max)
    grid[: len(v)] = v
    grid = grid.reshape(rows, w)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    on = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - WINDOW + 1
    at = (np.minimum(on[:windows], upto[w - 1 : w - 1 + windows]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    # windows that don't cross the end of their text
    starts = np.concatenate([[0], ends[:-1]])
    edge = np.zeros(windows + 1, np.int64)
    long_enough = ends - starts >= WINDOW
    np.add.at(edge, starts[long_enough], 1)
    np.add.at(edge, ends[long_enough] - WINDOW + 1, -1)
    valid = np.cumsum(edge)[:windows] > 0
    new = np.ones(windows, bool)
    new[1:] = (at[1:] != at[:-1]) | (edge[1:windows] != 0)
    first = np.flatnonzero(new & valid)
    return h[at[first]], first, at[first]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement."""
    n = len(text)
    # a suffix shorter than the first key counts as followed by zeros until its rank beyond the end tells it apart;
    # zeros that are text rule that out, so then single bytes come first
    h = 1 if n and (text[-8:] == 0).any() else 8
    key = words_at(text, ">")[:n] if h == 8 else text
    sa = np.argsort(key, kind="quicksort" if h == 8 else "stable").astype(np.int32)

    def group_starts(values, at):
        """For sorted values at the places at: the first place of each one's group, and whether it is alone."""
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(values), dtype=np.int32), 0))]
        return first, new & np.append(new[1:], True)

    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    places = np.arange(n, dtype=np.int32)
    rank[sa], alone = group_starts(key[sa], places)
    unsorted = places[~alone]
    while len(unsorted):
        p = sa[unsorted]
        both = rank[p].astype(np.int64) * (n + 2) + rank[np.minimum(p + np.int32(h), np.int32(n))]
        order = np.argsort(both)
        p = p[order]
        sa[unsorted] = p
        rank[p], alone = group_starts(both[order], unsorted)
        unsorted = unsorted[~alone]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int = WINDOW, lanes: int = 16384) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to most: Kasai's algorithm, which starts each
    suffix one byte below the last one's result. Many stretches of the text advance side by side."""
    n = len(text)
    u = words_at(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    lanes = max(1, min(lanes, n // 16 + 1))
    step = -(-n // lanes)
    out = np.zeros(n, np.int32)
    h = np.zeros(lanes, np.int32)
    begin = (np.arange(lanes) * step).astype(np.int32)
    for t in range(step):
        pos = begin + np.int32(t)
        if pos[-1] >= n:
            pos = pos[pos < n]
        j, own = before[pos], h[: len(pos)]
        own[j < 0] = 0
        # the longest that the text allows
        room = np.minimum(n - np.maximum(pos, j), most).astype(np.int32)
        todo = np.flatnonzero((j >= 0) & (own < room))
        while len(todo):
            k = own[todo]
            x = u[pos[todo] + k] ^ u[j[todo] + k]
            differ = x != 0
            own[todo] = k + 8
            if differ.any():
                x, at = x[differ], todo[differ]
                own[at] = k[differ] + (np.log2((x & (~x + np.uint64(1))).astype(np.float64)).astype(np.int32) >> 3)
                todo = todo[~differ]
            todo = todo[own[todo] < room[todo]]
        np.minimum(own, room, out=own)
        out[pos] = own
        np.maximum(own - 1, 0, out=own)
    return out[sa]


class Shard:
    """Distinct pieces with the number of times that each occurs."""

    def __init__(self, pieces: list[bytes], times: np.ndarray):
        self.text = np.frombuffer(b"".join(pieces), np.uint8)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(length)
        self.counts = length - WINDOW + 1
        # places of all windows, piece by piece
        own = np.cumsum(self.counts)
        self.at = np.arange(own[-1]) + np.repeat(ends - length - (own - self.counts), self.counts)
        sa = suffix_array(self.text)
        group = np.cumsum(common_prefixes(self.text, sa) < WINDOW)
        of = np.empty(len(sa), np.int64)
        of[sa] = group
        mine = of[self.at]
        weight = np.bincount(mine, np.repeat(times, self.counts), int(group[-1]) + 1)
        self.repeated = weight[mine] > 1
        self.of, self.sa = of, sa

    def sorted_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct window, in order of their bytes; number of that window for every window)."""
        rank = np.empty(len(self.sa), np.int64)
        rank[self.sa] = np.arange(len(self.sa))
        order = np.argsort(rank[self.at])
        groups = self.of[self.at[order]]
        new = np.ones(len(groups), bool)
        new[1:] = groups[1:] != groups[:-1]
        number = np.empty(len(groups), np.int64)
        number[order] = np.cumsum(new) - 1
        return self.at[order[new]], number

    def masks(self) -> list[np.ndarray]:
        return np.split(self.repeated, np.cumsum(self.counts)[:-1])


def window_words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return text[at[:, None] + np.arange(WINDOW)].view(">u8")


def search(text: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray, most: int = 20_000) -> np.ndarray:
    """Index in other_at (in order of their bytes) of each window at, or -1: binary search of all of them at once."""
    out = np.full(len(at), -1, np.int64)
    for a in range(0, len(at), most):
        want = window_words(text, at[a : a + most])
        low, high = np.zeros(len(want), np.int64), np.full(len(want), len(other_at))
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            have, asked = window_words(other, other_at[mid]), want[k]
            differ = have != asked
            col = differ.argmax(axis=1)
            row = np.arange(len(k))
            equal = ~differ[row, col]
            out[a + k[equal]] = mid[equal]
            less = have[row, col] < asked[row, col]
            low[k] = np.where(equal, high[k], np.where(less, mid + 1, low[k]))
            high[k] = np.where(equal | less, high[k], mid)
    return out


def merge_shards(shards: list[Shard]) -> None:
    """Marks the windows that two of these shards have in common. What is kept of a shard meanwhile lies on disk."""
    with tempfile.TemporaryDirectory() as folder:
        held = []
        for k, s in enumerate(shards):
            at, number = s.sorted_windows()
            np.save(f"{folder}/text{k}.npy", s.text)
            np.save(f"{folder}/at{k}.npy", at)
            s.text, s.sa, s.of, s.at = None, None, None, None
            held.append((np.load(f"{folder}/text{k}.npy", "r"), np.load(f"{folder}/at{k}.npy", "r"), np.zeros(len(at), bool), number))
        for k, (text, at, hit, _) in enumerate(held):
            for other, other_at, other_hit, _ in held[:k]:
                found = search(text, np.asarray(at), other, other_at)
                hit |= found >= 0
                other_hit[found[found >= 0]] = True
        for s, (_, _, hit, number) in zip(shards, held, strict=True):
            s.repeated |= hit[number]
        del held


def repeated_in(keys: Iterable[tuple[list[bytes], np.ndarray]], shard: int | None = None) -> Iterable[list[np.ndarray]]:
    """For the distinct pieces of each leader, which of their windows occur more than once among that leader's pieces."""
    most = SHARD if shard is None else shard
    held: list[tuple[list[bytes], np.ndarray]] = []
    size = 0

    def close():
        several = [x for x in held if len(x[0]) > 1]
        masks = iter(Shard([p for pieces, _ in several for p in pieces], np.concatenate([t for _, t in several])).masks() if several else ())
        for pieces, times in held:
            # no two windows of one run are equal
            yield [next(masks) for _ in pieces] if len(pieces) > 1 else [np.full(len(pieces[0]) - WINDOW + 1, times[0] > 1)]
        held.clear()

    for pieces, times in keys:
        own = sum(map(len, pieces)) if len(pieces) > 1 else 0
        if held and (size + own > most or len(held) >= 50_000):
            yield from close()
            size = 0
        if own > most:
            parts, a, n = [], 0, 0
            for k, p in enumerate(pieces):
                n += len(p)
                if n >= most or k == len(pieces) - 1:
                    parts.append(Shard(pieces[a : k + 1], times[a : k + 1]))
                    a, n = k + 1, 0
            merge_shards(parts)
            yield [m for s in parts for m in s.masks()]
            continue
        held.append((pieces, times))
        size += own
    if held:
        yield from close()


def _digest(text: bytes) -> tuple[str, int]:
    d = hashlib.sha256(text)
    return d.hexdigest(), int.from_bytes(d.digest()[:8], "little", signed=True)


def _pass(texts: list[bytes], most: int):
    """(from, to) of slices of texts of about most bytes."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= most):
            size += len(texts[b])
            b += 1
        yield a, b
        a = b


def _runs_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of each text; a text longer than a scan is cut, with WINDOW - 1 bytes in common."""
    out = []
    for a, b in _pass(texts, SCAN):
        if b == a + 1 and len(texts[a]) > 4 * SCAN:
            got = []
            for k in range(0, len(texts[a]) - WINDOW + 1, SCAN):
                part = np.frombuffer(texts[a], np.uint8)[k : k + SCAN + WINDOW - 1]
                h, first, at = runs(part, np.array([len(part)]))
                got.append((h, first + k, at + k))
            out.append(tuple(np.concatenate(x) for x in zip(*got, strict=True)))
            continue
        ends = np.cumsum(np.fromiter(map(len, texts[a:b]), np.int64, b - a))
        h, first, at = runs(np.frombuffer(b"".join(texts[a:b]), np.uint8), ends)
        cut = np.searchsorted(first, ends)[:-1] if len(ends) > 1 else []
        starts = np.concatenate([[0], ends[:-1]])
        out += [(x, y - s, z - s) for x, y, z, s in zip(np.split(h, cut), np.split(first, cut), np.split(at, cut), starts, strict=True)]
    return out


def _scan(batches):
    for pdf in batches:
        texts = [t.encode() for t in pdf["t"]]
        found = _runs_of(texts)
        shas = [_digest(t) for t in texts]
        yield pd.DataFrame(
            {
                "doc_id": pd.array(pdf["doc_id"], "Int64"),
                "sha": [s for s, _ in shas],
                "t1": [x for _, x in shas],
                "n_bytes": [len(t) for t in texts],
                "leaders": [h.view(np.int64) for h, _, _ in found],
                "firsts": [x.astype(np.int32) for _, x, _ in found],
                "places": [x.astype(np.int32) for _, _, x in found],
            }
        )


def _sub_runs(text: bytes, first: int, stop: int, place: int, leader: int):
    """Cuts a run by the distance of its windows from the leader's place; the key then has the bytes they share."""
    a = first
    while a < stop:
        q = (place - a) // CUT
        b = min(stop, place - CUT * q + 1)
        shared = text[place - CUT * q : place - CUT * q + WINDOW - CUT + 1]
        yield xxhash.xxh3_64_intdigest(shared, seed=(leader + q) & ((1 << 64) - 1)), a, b
        a = b


def _cut(batches):
    """Pieces of each task, equal ones once, and where they occur."""
    for pdf in batches:
        held: dict[bytes, list] = {}
        places, size = [], 0

        def out():
            nonlocal size
            pieces = pd.DataFrame([(int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), *x) for d, x in held.items()], columns=["p1", "p2", "leader", "piece", "times"])
            yield pieces.assign(k=pd.array([None] * len(pieces), "Int64"), t1=pd.array([None] * len(pieces), "Int64"), first=pd.array([None] * len(pieces), "Int32"))
            occurs = pd.DataFrame(places, columns=["p1", "p2", "k", "t1", "first"])
            n = len(occurs)
            yield occurs.assign(leader=pd.array([None] * n, "Int64"), piece=pd.Series([None] * n, dtype=object), times=pd.array([None] * n, "Int64"))[["p1", "p2", "leader", "piece", "times", "k", "t1", "first"]]
            held.clear()
            places.clear()
            size = 0

        for t, k, t1, n, found in zip(pdf["t"], pdf["k"], pdf["t1"], pdf["n"], pdf["runs"], strict=True):
            text = t.encode()
            for r in found:
                first, stop, leader = r["first"], r["stop"], r["leader"]
                cuts = _sub_runs(text, first, stop, r["place"], leader) if r["often"] else [(leader, first, stop)]
                for key, a, b in cuts:
                    piece = text[a : b + WINDOW - 1]
                    d = xxhash.xxh3_128_digest(piece)
                    if (had := held.get(d)) is None:
                        key &= (1 << 64) - 1
                        held[d] = [key - (1 << 64) if key >> 63 else key, piece, n]
                        size += len(piece)
                    else:
                        had[2] += n
                    places.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), k, t1, a))
            if size > COMBINE or len(places) > 100_000:
                yield from out()
        if places:
            yield from out()


def _judge(batches):
    """Repeated windows of each distinct piece, from pieces sorted by (leader, p1, p2)."""
    names: list[list[tuple[int, int]]] = []

    def keys():
        last, pieces, times, ids = None, [], [], []
        for pdf in batches:
            for leader, p1, p2, piece, n in zip(pdf["leader"], pdf["p1"], pdf["p2"], pdf["piece"], pdf["times"], strict=True):
                if leader != last and ids:
                    names.append(ids)
                    yield pieces, np.array(times)
                    pieces, times, ids = [], [], []
                last = leader
                if ids and ids[-1] == (p1, p2):
                    times[-1] += n
                else:
                    pieces.append(bytes(piece))
                    times.append(n)
                    ids.append((p1, p2))
        if ids:
            names.append(ids)
            yield pieces, np.array(times)

    rows = []
    at = 0
    for masks in repeated_in(keys()):
        ids = names[at]
        names[at] = None
        at += 1
        rows += [(*i, np.packbits(m).tobytes(), len(m)) for i, m in zip(ids, masks, strict=True) if m.any()]
        if len(rows) > 20_000:
            yield pd.DataFrame(rows, columns=["p1", "p2", "mask", "windows"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["p1", "p2", "mask", "windows"])


def removed_bytes(lengths: np.ndarray, marks: pa.ListArray) -> np.ndarray:
    """Which bytes are covered, of texts of these lengths that lie end to end. marks: lists of (first, mask)."""
    edge = np.zeros(int(lengths.sum()) + 1, np.int64)
    offsets = marks.offsets.to_numpy()
    flat = marks.values
    masks = flat.field("mask")
    begin = np.frombuffer(masks.buffers()[1], np.int32)[masks.offset : masks.offset + len(masks) + 1].astype(np.int64)
    data = np.frombuffer(masks.buffers()[2] or b"", np.uint8)
    low, high = int(offsets[0]), int(offsets[-1])
    if high > low:
        bit = np.flatnonzero(np.unpackbits(data[begin[low] : begin[high]])) + 8 * begin[low]
        mark = np.searchsorted(8 * begin, bit, side="right") - 1
        text = np.searchsorted(offsets, mark, side="right") - 1
        start = flat.field("first").to_numpy()[mark] + bit - 8 * begin[mark] + (np.cumsum(lengths) - lengths)[text]
        edge += np.bincount(start, minlength=len(edge))
        edge -= np.bincount(start + WINDOW, minlength=len(edge))
    return np.cumsum(edge)[:-1] > 0


def _kept(column: pa.Array, marks: pa.ListArray):
    """(number, text, which of its bytes go) of each text; null texts are empty."""
    texts = [(t or "").encode() for t in column.to_pylist()]
    at = 0
    for a, b in _pass(texts, 1 << 20):
        lengths = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        gone = removed_bytes(lengths, marks.slice(a, b - a))
        for k, g in enumerate(np.split(gone, np.cumsum(lengths)[:-1])):
            yield at + k, texts[a + k], g
        at += b - a


def _t1(text: Column) -> Column:
    """What _digest has as its number."""
    hex_ = F.substring(F.sha2(text, 256), 1, 16)
    return F.conv(F.concat(*(F.substring(hex_, 15 - 2 * k, 2) for k in range(8))), 16, -10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with k and t1: texts that share a doc_id or have none are told apart by their digests."""
    return docs.select("t", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), _t1(F.col("t")).alias("t1"))


def _find(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned documents, copies of each text, marks of the texts that have any) for docs of (doc_id, t)."""
    scanned = saved(spread(docs).mapInPandas(_scan, "doc_id long, sha string, t1 long, n_bytes long, leaders array<long>, firsts array<int>, places array<int>"), "scanned")
    texts = saved(
        scanned.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("k"), *(F.first(c).alias(c) for c in ("t1", "n_bytes", "leaders", "firsts", "places"))),
        "texts",
    )
    slim = saved(scanned.select("doc_id", "sha", "t1", "n_bytes"), "documents")
    drop_table(scanned)
    # the end of a run is the first window of the next
    stops = F.concat(F.slice("firsts", 2, F.greatest(F.size("firsts") - 1, F.lit(0))), F.array((F.col("n_bytes") - (WINDOW - 1)).cast("int")))
    zipped = F.arrays_zip(F.col("leaders").alias("leader"), F.col("firsts").alias("first"), stops.alias("stop"), F.col("places").alias("place"))
    rows = texts.where(F.size("leaders") > 0).select("k", "t1", "n", F.inline(zipped)).toDF("k", "t1", "n", "leader", "first", "stop", "place")
    # written, so that the join deals it out anew and Spark can split a frequent leader's side of it
    often = saved(rows.groupBy("leader").agg(F.sum("n").alias("c")).where("c > 1").select("leader", (F.col("c") >= FREQUENT).alias("often")), "leaders")
    chosen = rows.join(often, "leader").groupBy("k", "t1").agg(F.first("n").alias("n"), F.collect_list(F.struct("leader", "first", "stop", "place", "often")).alias("runs"))
    cut = _keyed(docs).join(chosen, ["k", "t1"]).select("t", "k", "t1", "n", "runs").mapInPandas(_cut, "p1 long, p2 long, leader long, piece binary, times long, k long, t1 long, first int")
    pieces = saved(cut, "pieces")
    copies = saved(texts.select("sha", "n"), "copies")
    drop_table(texts)
    drop_table(often)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where("piece is not null").select("leader", "p1", "p2", "piece", "times").repartition(parts, "leader").sortWithinPartitions("leader", "p1", "p2")
    masks = dealt.mapInPandas(_judge, "p1 long, p2 long, mask binary, windows int")
    marks = pieces.where("piece is null").select("p1", "p2", "k", "t1", "first").join(masks, ["p1", "p2"]).groupBy("k", "t1").agg(F.collect_list(F.struct("first", "mask", "windows")).alias("marks"))
    marks = saved(marks, "marks")
    drop_table(pieces)
    return slim, copies, marks


def repeat_report(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    scanned, copies, marks = _find(docs)

    def remove(batches):
        for batch in batches:
            out = []
            for _, t, gone in _kept(batch.column("t"), batch.column("marks")):
                b = np.frombuffer(t, np.uint8)
                out.append((_digest(t)[0], int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()), hashlib.sha256(b[~gone].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["sha", "gone", "spans", "kept"]).astype({"gone": "int64", "spans": "int64"}), preserve_index=False, schema=pa.schema([("sha", pa.string()), ("gone", pa.int64()), ("spans", pa.int64()), ("kept", pa.string())]))

    found = _keyed(docs).join(marks, ["k", "t1"]).select("t", "marks").mapInArrow(remove, "sha string, gone long, spans long, kept string").dropDuplicates(["sha"])
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= WINDOW)
    return scanned.select("doc_id", "sha", "n_bytes").join(copies.join(found, "sha", "left"), "sha").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """df with text reduced to the bytes that stay and chars to its length. Null text without repeats stays null."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    scanned, copies, marks = _find(docs)
    twice = copies.where("n > 1").join(scanned.where(F.col("n_bytes") >= WINDOW).select("sha", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "t1"), "sha").select("k", "t1").distinct()
    change = marks.join(twice.withColumn("all_gone", F.lit(True)), ["k", "t1"], "full")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # the row goes as one column, whatever its own are called
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), _t1(whole).alias("t1"))
    joined = rows.join(change, ["k", "t1"], "left").select("row", "all_gone", "marks")
    own, place = F.col("row").getField(text), df.columns.index(text)
    rest = [F.col("row").getField(c).alias(c) for c in df.columns]
    emptied = F.when(F.col("all_gone") & own.isNotNull(), F.lit("")).otherwise(own).alias(text)
    same = joined.where("marks is null or all_gone").select(*rest[:place], emptied, *rest[place + 1 :])

    def remove(batches):
        for batch in batches:
            row = batch.column(0)
            fields = row.flatten()
            new = [np.frombuffer(t, np.uint8)[~gone].tobytes().decode(errors="ignore") for _, t, gone in _kept(fields[place], batch.column(1))]
            fields[place] = pa.array(new, fields[place].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], ["row"])

    schema = T.StructType([T.StructField("row", df.schema)])
    new = joined.where("marks is not null and not coalesce(all_gone, false)").select("row", "marks").mapInArrow(remove, schema).select("row.*")
    both = same.union(new)
    return both.withColumn(chars, F.length(text).cast(df.schema[chars].dataType)) if chars in df.columns else both
