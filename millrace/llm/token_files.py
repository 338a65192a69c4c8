"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds a stretch of the corpus in ascending doc_id order, cut into sequences of equal length: a batch has
`ids` (fixed-size lists of token ids) and `mask` (fixed-size lists of bits: false for padding). Only a file's last sequence has padding. All batches of a file but the last have equally many
sequences, hence equally many bytes, so sequence i is found by arithmetic and read from a memory map without
copying (ids as numpy, masks as the bits that Arrow keeps booleans in). Ids have 16 bits, or 32 where the vocabulary
is larger. Beside each file lies its index of documents (doc_id, first, n_tokens), also an Arrow stream.

A task writes its file under a name of its own and renames it when it is whole, so a task that is run again
leaves no half of a file. Documents are ordered by (doc_id, hash of the text, text), null doc_id first, so rows that
share an id are dealt over files too; null text is empty and has
the end id alone; an empty table gives no files and an empty result; repeated rows are separate documents.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import portable
from millrace.llm.common import saved, scratch
from millrace.llm.pretokens import PieceEncoder, is_plain

SEQUENCE = 2048
#: Sequences in a batch of a file.
BATCH = 64
END_ID = 0


#: Byte-level vocabularies write each byte as a character: visible ones of Latin-1 as themselves, all others as those
#: from U+0100 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _SEEN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


class LibraryEncoder:
    """The tokenizers library. Texts are cut in pieces by the tokenizer's pattern, and the library's BPE model is asked
    once for each distinct piece that a worker remembers.

    A text with characters that engines of another Unicode version might class otherwise goes to the library whole."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.vocabulary = self.library.get_vocab_size()
        self.model = self.library.model
        self.pieces = PieceEncoder(portable(pattern), self.stretches)

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of whole pieces, and their numbers. Letters, with a space before or a stop behind them or
        without, are cut as the pattern cuts them."""
        find, tokenize = self.pieces.find, self.model.tokenize
        flat: list[int] = []
        ends = [0]
        for t in texts:
            core = t[1:] if t[:1] == " " else t
            for x in (t,) if core.isalpha() else (t[:-1], t[-1]) if core[:-1].isalpha() and core[-1] in ".," else find(t):
                chars = x.replace(" ", "\u0120") if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(BYTE_CHARS)
                for k in tokenize(chars):
                    flat.append(k.id)
            ends.append(len(flat))
        return np.array(flat, np.uint32), np.diff(ends)

    def each(self, texts: pa.Array):
        plain = is_plain(texts)
        known = iter(self.pieces.each(texts.filter(pa.array(plain))))
        for k, p in enumerate(plain.tolist()):
            yield next(known) if p else np.array(self.library.encode_batch_fast([texts[k].as_py()], add_special_tokens=False)[0].ids, np.uint32)


@lru_cache(maxsize=2)
def library(path: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(path, pattern)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Writer:
    """Writes one file of sequences and its index."""

    def __init__(self, fs: pafs.FileSystem, path: str, length: int = SEQUENCE, batch: int = BATCH, id_type=pa.uint16()):
        self.fs, self.path, self.own = fs, path, f"{path}.{uuid.uuid4().hex}.part"
        self.length, self.batch = length, batch
        self.schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))], {"sequence": str(length), "batch": str(batch)})
        self.sink = fs.open_output_stream(self.own)
        self.out = ipc.new_stream(self.sink, self.schema)
        self.dtype = id_type.to_pandas_dtype()
        self.ids, self.held = [], 0
        self.keys, self.first, self.count, self.total = [], [], [], 0

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.first.append(self.total)
        self.count.append(len(ids))
        self.total += len(ids)
        if len(ids) and ids.max() > np.iinfo(self.dtype).max:
            raise ValueError(f"id {ids.max()} doesn't fit in {np.dtype(self.dtype)}")
        self.ids.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= 4 * self.length * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.ids, np.empty(0, self.dtype)])
        step = self.length * self.batch
        tokens = len(ids)
        whole = len(ids) if last else len(ids) // step * step
        if last and whole % self.length:
            pad = self.length - whole % self.length
            ids, whole = np.concatenate([ids, np.zeros(pad, self.dtype)]), whole + pad
        for a in range(0, whole, step):
            b = min(a + step, whole)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[a:b], t.type.value_type), self.length) for x, t in ((ids, self.schema.field(0)), (np.arange(whole) < tokens, self.schema.field(1)))]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.ids, self.held = [ids[whole:]], len(ids) - whole

    def close(self, key_type=pa.int64()) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        index = pa.table({"doc_id": pa.array(self.keys, key_type), "first": pa.array(self.first, pa.int64()), "n_tokens": pa.array(self.count, pa.int64())})
        with self.fs.open_output_stream(self.own + ".index") as f, ipc.new_stream(f, index.schema) as out:
            out.write_table(index, max_chunksize=1 << 16)
        for end in (".index", ""):
            _replace(self.fs, self.own + end, self.path + end)


def _replace(fs: pafs.FileSystem, a: str, b: str) -> None:
    """A task that ran before may have left the same file, of the same bytes."""
    try:
        fs.move(a, b)
    except OSError:
        if fs.get_file_info(b).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(b)
        fs.move(a, b)


class Sequences:
    """Random access to the sequences of a file without copying."""

    def __init__(self, path: str):
        self.map = pa.memory_map(path)
        #: The whole file, as it lies in memory.
        self.whole = self.map.read_buffer()
        self.map.seek(0)
        reader = ipc.open_stream(self.map)
        self.schema = reader.schema
        self.batch = int(self.schema.metadata[b"batch"])
        begin = self.map.tell()
        first = reader.read_next_batch() if self.map.size() > begin else None
        self.begin, self.step = begin, self.map.tell() - begin
        self.n = 0
        if first is not None:
            # all batches but the last have the bytes of the first
            whole = max(0, (self.map.size() - begin - 8) // self.step - 1)
            self.map.seek(begin + whole * self.step)
            self.n = whole * self.batch
            while (b := self._next()) is not None:
                self.n += b.num_rows

    def _next(self):
        m = ipc.read_message(self.map) if self.map.size() - self.map.tell() > 8 else None
        return None if m is None else ipc.read_record_batch(m, self.schema)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids as numpy, mask as Arrow's bits), both in place in the map."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        self.map.seek(self.begin + i // self.batch * self.step)
        b, k = self._next(), i % self.batch
        return b.column(0)[k].values.to_numpy(zero_copy_only=True), b.column(1)[k].values


def write_token_files(df: DataFrame, path: str, pattern: str, out: str, text: str = "text", length: int = SEQUENCE) -> DataFrame:
    """Writes df's texts below out; returns the manifest (part, file, n_docs, n_tokens), written in the shared folder."""
    rows = df.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "t")

    def run(batches):
        part, writer, n = TaskContext.get().partitionId(), None, 0
        fs, base = filesystem(out)
        for b in batches:
            encoder = library(path, pattern)
            for key, ids in zip(b.column(0).to_pylist(), encoder.each(b.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = Writer(fs, name := f"{base}/tokens-{part:06d}.arrows", length, id_type=pa.uint16() if encoder.vocabulary <= 1 << 16 else pa.uint32())
                writer.add(key, np.append(ids, np.uint32(END_ID)))
                n += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [os.path.basename(name)], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64())})

    return saved(dealt.mapInArrow(run, "part long, file string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files in the manifest."""
    # a row for each file
    start = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", start.alias("before"))

    def run(batches):
        fs, base = filesystem(out)
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from documents_of(fs, f"{base}/{name}", before)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents_of(fs: pafs.FileSystem, path: str, before: int = 0):
    with fs.open_input_file(path) as data, fs.open_input_file(path + ".index") as index:
        stream = iter(ipc.open_stream(data))
        ids, at = np.empty(0, np.uint32), 0  # not yet used; at: where they begin in the file
        for docs in ipc.open_stream(index):
            crc = []
            for first, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                parts, ids, at = [ids[first - at :]], None, first
                while (have := sum(map(len, parts))) < n:
                    b = next(stream)
                    got, mask = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                    parts.append(got[mask])
                ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
                crc.append(zlib.crc32(ids[:n].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(np.asarray(docs.column(1)) + before, pa.int64()), docs.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_report(df: DataFrame, path: str, pattern: str, length: int = SEQUENCE) -> DataFrame:
    out = scratch(df.sparkSession, "token-files")
    return read_token_files(write_token_files(df, path, pattern, out, length=length), out)
