"""Byte-level BPE texts as stretches of whole pieces of the tokenizer's pattern; every distinct stretch of a
batch of texts is encoded once. Bounded by the batch and a memory of limited size.

A text is cut by the pattern itself; or, if no two characters of white space stand together in it, before each
space and around each line feed. There the pattern cuts too: single white space is a piece of its own or the head
of one, and nothing but white space is looked ahead for."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Distinct stretches whose ids a worker remembers; the memory is emptied beyond it.
REMEMBERED = 1_200_000
#: Bytes of text that are cut at once.
CHUNK_BYTES = 12_000_000
#: What keeps a text from being cut at single spaces and line feeds: white space that stands together or is neither, and
#: characters from U+0250 on, which engines of another Unicode version might class otherwise.
NOT_PLAIN = r"[^\x{0}-\x{24f}]"
NOT_SINGLE = r"  |\n\n| \n|\n |[\x{0}\t\r\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}]|" + NOT_PLAIN


def is_plain(texts: pa.Array) -> np.ndarray:
    """Whether each text has no character from U+0250 on."""
    return ~pc.match_substring_regex(texts, NOT_PLAIN).to_numpy(zero_copy_only=False)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Rows(dict):
    """Numbers strings in the order in which they first come; new has those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        self.new.append(text)
        row = self[text] = len(self)
        return row


def grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size - len(x), len(x)), x.dtype)])


class PieceEncoder:
    """Encodes texts by encode_all, which gets distinct stretches of whole pieces and returns all their ids on end
    and the number of each one's."""

    def __init__(self, pattern: str, encode_all: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.find = regex.compile(pattern).findall
        self.encode_all = encode_all
        self.clear()

    def clear(self) -> None:
        self.rows = _Rows()
        self.ids, self.start, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0

    def learn(self) -> None:
        flat, lengths = self.encode_all(self.rows.new)
        used, n = self.start[self.n], len(lengths)
        self.ids, self.start = grown(self.ids, used + len(flat)), grown(self.start, self.n + n + 1)
        self.ids[used : used + len(flat)] = flat
        self.start[self.n + 1 : self.n + n + 1] = used + np.cumsum(lengths)
        self.n += n
        self.rows.new = []

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row of every stretch, number of stretches of each text). Arrow cuts the single-spaced texts and finds their
        distinct stretches."""
        hard = pc.match_substring_regex(texts, NOT_SINGLE).to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(~hard)), " ", "\0 "), "\n", "\0\n\0")
        parts = pc.split_pattern(marked, "\0")
        coded = parts.flatten().dictionary_encode()
        known = self._rows_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        if not hard.any():
            return known[coded.indices.to_numpy()], pc.list_value_length(parts).to_numpy().astype(np.int64)
        found = [self.find(t) for t in texts.filter(pa.array(hard)).to_pylist()]
        counts = np.zeros(len(texts), np.int64)
        counts[~hard] = pc.list_value_length(parts).to_numpy()
        counts[hard] = np.fromiter(map(len, found), np.int64, len(found))
        rows = np.empty(int(counts.sum()), np.int64)
        of_hard = np.repeat(hard, counts)
        rows[~of_hard] = known[coded.indices.to_numpy()]
        rows[of_hard] = self._rows_of([x for f in found for x in f])
        return rows, counts

    def _rows_of(self, stretches: list[str]) -> np.ndarray:
        return np.fromiter(map(self.rows.__getitem__, stretches), np.int64, len(stretches))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids of each text)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if len(self.rows) > REMEMBERED:
            self.clear()
        rows, counts = self.cut(texts)
        if self.rows.new:
            self.learn()
        begin, length = self.start[rows], self.start[rows + 1] - self.start[rows]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def each(self, texts: list[str] | pa.Array) -> Iterable[np.ndarray]:
        """The ids of each text, cut in chunks of bounded size."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + size[j] <= CHUNK_BYTES):
                held += size[j]
                j += 1
            ids, n = self.encode(texts.slice(i, j - i))
            yield from np.split(ids, np.cumsum(n)[:-1])
            i = j
