"""Byte-level BPE encoding and decoding, two tiers.

A text is cut by the tokenizer's pattern (distinct stretches of a batch once, see pretokens). A piece that is a token itself is found by a minimal perfect hash
over the vocabulary (compress, hash and displace: a displacement for each bucket, a slot for each token, and
the token compared at its slot). Every other piece is merged by rank, with a heap of candidate pairs over a
doubly linked list of its bytes. Ids are those of the tiktoken library for the same ranks and pattern.

Defined results: null is the empty text, which has no ids; every Unicode text round-trips; repeated rows get
equal rows; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, spread
from millrace.llm.pretokens import PieceEncoder, load_ranks

#: The class of white space for the pattern; Python's \s has U+001C to U+001F besides.
WHITE = r"\t-\r\x20\x85\xa0  -     　"


def portable(pattern: str) -> str:
    """pattern with \\s and \\S as Unicode's White_Space, whatever the engine takes them for."""
    inside, out, i = False, [], 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE if inside else f"[{WHITE}]")
        elif two == r"\S":
            if inside:
                raise ValueError("\\S inside a class isn't supported")
            out.append(f"[^{WHITE}]")
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            two = two if pattern[i] == "\\" else pattern[i]
            out.append(two)
        i += len(two)
    return "".join(out)


class PerfectHash:
    """Minimal perfect hash over distinct byte strings: n keys, n slots, two integers a key."""

    def __init__(self, keys: list[bytes], load: int = 4):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // load)
        self.displace = np.zeros(self.buckets, np.int64)
        self.slots = np.full(n, -1, np.int64)
        a, b = self._hashes(keys)
        order = np.argsort(a, kind="stable")
        edges = np.searchsorted(a[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        tries = np.arange(64, dtype=np.uint64)[:, None]
        for k in np.argsort(-np.diff(edges), kind="stable"):
            own = order[edges[k] : edges[k + 1]]
            if len(own) < 2:
                break
            d = 0
            while True:
                at = np.sort(self._slot(b[own], tries + np.uint64(d)), axis=1)
                fits = ~taken[at].any(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1)
                if fits.any():
                    d += int(fits.argmax())
                    break
                d += len(tries)
                if d > 10_000_000:
                    raise ValueError("keys aren't distinct")
            at = self._slot(b[own], d)
            taken[at] = True
            self.displace[k], self.slots[at] = d, own
        # a bucket of one key names a free slot itself, as a negative number
        alone = np.flatnonzero(np.diff(edges) == 1)
        free = np.flatnonzero(~taken)
        self.displace[alone], self.slots[free] = -1 - free, order[edges[alone]]

    def _hashes(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        return (h % np.uint64(self.buckets)).astype(np.int64), h

    def _slot(self, h: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = h ^ (np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """The only key number that each key can have; whether it has it is to be compared."""
        a, h = self._hashes(keys)
        d = self.displace[a]
        return self.slots[np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))]


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens, self.token_ids = list(ranks), np.fromiter(ranks.values(), np.uint32, len(ranks))
        self.ranks = ranks
        self.hash = PerfectHash(self.tokens)
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.pieces = PieceEncoder(portable(pattern), self.encode_all)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        find = self.pieces.find
        cut = [find(t) for t in texts]
        raw = [x.encode() for pieces in cut for x in pieces]
        known = iter(zip(raw, self.hash.candidates(raw).tolist(), strict=True))
        tokens, ids, merge = self.tokens, self.token_ids.tolist(), self.merge
        flat: list[int] = []
        ends = [0]
        for pieces in cut:
            for _ in pieces:
                x, k = next(known)
                if tokens[k] == x:
                    flat.append(ids[k])
                else:
                    flat += merge(x)
            ends.append(len(flat))
        return np.array(flat, np.uint32), np.diff(ends)

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until no neighbours make a token."""
        ranks, n = self.ranks, len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            # stale if either side has been merged since
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [ranks[x] for x in part if x]

    def encode(self, text: str) -> np.ndarray:
        return self.pieces.encode([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """Built once a worker."""
    return Bpe(load_ranks(path), pattern)


def each_batch(path: str, pattern: str, body, batches):
    """body of every batch; then what the batches took is given back, since the worker lives on in other stages."""
    bpe = load(path, pattern)
    for pdf in batches:
        yield body(bpe, pdf)
    pdf = None
    bpe.pieces.clear()
    release()


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, ids as binary little-endian unsigned 32-bit integers, n_tokens)."""

    def ids_of(bpe, pdf):
        ids = list(bpe.pieces.each(pdf["t"].tolist()))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [x.astype("<u4").tobytes() for x in ids], "n_tokens": [len(x) for x in ids]})

    run = partial(each_batch, path, pattern, ids_of)
    return spread(df.select("doc_id", text)).select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInPandas(run, _schema(df, "ids binary, n_tokens long"))


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids."""

    def digests_of(bpe, pdf):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out = [(len(x), sha(x.astype("<u4").tobytes()), sha(bpe.decode(x))) for x in bpe.pieces.each(pdf["t"].tolist())]
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=pdf["doc_id"].to_numpy())

    run = partial(each_batch, path, pattern, digests_of)
    return spread(df.select("doc_id", text)).select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).mapInPandas(run, _schema(df, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _schema(df: DataFrame, rest: str) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {rest}"
