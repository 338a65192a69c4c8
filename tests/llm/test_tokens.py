import hashlib
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import bpe, token_files
from millrace.llm.pretokens import load_ranks

ODD = [None, "", " ", "\n\n  x  ", "a\x1cb\x1d c\x85 d  e　f", "it's we'll ''s <|endoftext|> !", "né ñ ß 漢字 😀 ١٢ ²", "x" * 5000, "ab " * 2000, "\x00﻿​ z"]


def rows(seed=1):
    r = random.Random(seed)
    alphabet = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0x1F, 0x85, 0xA0, 0xE9, 0x2009, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x1D7CE]]
    made = ["".join(r.choices(alphabet, k=r.randrange(1, 60))) for _ in range(300)]
    return [(i, t) for i, t in enumerate([*ODD, *made, *made[:5]])]


@pytest.fixture(scope="module")
def expected():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_perfect_hash_is_minimal_and_exact(own):
    h = own.hash
    assert sorted(h.slots.tolist()) == list(range(len(own.tokens)))
    assert h.candidates(own.tokens).tolist() == list(range(len(own.tokens)))
    assert bpe.PerfectHash([b"a"]).candidates([b"a", b"b"]).tolist() == [0, 0]


def test_merge_equals_the_library(own, expected):
    for _, t in rows():
        assert own.encode(t or "").tolist() == expected.encode_ordinary(t or "")
        assert own.decode(own.encode(t or "")) == (t or "").encode()


def test_stretches_end_where_pieces_end(own, expected):
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choices(["a", "b's", "'", "!", "1", " ", "\n", "\t", "é", "\x85", "''s", "?"], k=r.randrange(1, 12)))
        assert own.encode(t).tolist() == expected.encode_ordinary(t), repr(t)


def test_white_space_and_letters_of_all_of_unicode(own, expected):
    step = 400
    for a in range(0, 0x30000, step):
        t = "".join(f"a{c}1{c}{c} b{c}\n" for c in map(chr, range(a, a + step)) if not 0xD800 <= ord(c) < 0xE000)
        assert own.encode(t).tolist() == expected.encode_ordinary(t), hex(a)


def test_bpe_query(spark, expected):
    df = spark.createDataFrame([(*x, "en") for x in rows()], "doc_id long, text string, t string")
    got = {r.doc_id: r for r in bpe.digests(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert len(got) == len(rows())
    for i, t in rows():
        ids = expected.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert bpe.encoded(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).agg({"n_tokens": "sum"}).head()[0] == sum(r.n_tokens for r in got.values())


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    data = rows(2)
    df = spark.createDataFrame([(*x, "en") for x in data], "doc_id long, text string, t string").repartition(5)
    out = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(df, P.path("byte_bpe_50k.json"), P.PATTERN, out, length=64)
    got = {r.doc_id: r for r in token_files.read_token_files(manifest, out).collect()}
    start = 0
    stream = []
    for i, t in data:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)
        stream += ids
    files = sorted(manifest.collect(), key=lambda r: r.part)
    read = []
    for f in files:
        s = token_files.Sequences(f"{tmp_path}/files/{f.file}")
        assert len(s) == -(-f.n_tokens // 64)
        for k in random.Random(3).sample(range(len(s)), len(s)):
            assert all(len(x) == 64 for x in s[k])
        for k in range(len(s)):
            ids, mask = s[k]
            begin, end = s.whole.address, s.whole.address + s.whole.size
            assert begin <= ids.ctypes.data < end and begin <= mask.buffers()[1].address < end  # in place, not copied
            read += ids[np.array(mask)].tolist()
    assert read == stream
    assert not [p for p in (tmp_path / "files").iterdir() if ".part" in p.name]


def test_stretches_of_the_library_equal_whole_texts():
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    r = random.Random(9)
    marks = ["a", "b's", "'", "!", "1", " ", " ", "\n", "\t", "é", "ß", "ÿ", "\x7f", "\xad", "\x85", "''s", "?", "zq", "<|endoftext|>"]
    texts = ["".join(r.choices(marks, k=r.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(f"a{c}1{c}{c} b{c}\n" for c in map(chr, range(a, a + 16))) for a in range(0, 0x300, 16)]
    texts += [" ".join("".join(r.choices("abcdeghißé", k=r.randrange(1, 9))) for _ in range(200)) for _ in range(30)]
    encoder = token_files.library(P.path("byte_bpe_50k.json"), P.PATTERN)
    for t, ids in zip(texts, encoder.each(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_that_do_not_fit_are_refused(tmp_path):
    fs, path = token_files.filesystem(f"{tmp_path}/x")
    writer = token_files.Writer(fs, path, 4)
    with pytest.raises(ValueError):
        writer.add(1, np.array([1 << 16], np.uint32))


def test_rows_that_share_an_id_are_dealt_over_files(spark, tmp_path):
    df = spark.createDataFrame([(None if k % 2 else 7, f"text {k}") for k in range(400)], "doc_id long, text string").repartition(8)
    out = f"file://{tmp_path}/files"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(df, P.path("byte_bpe_50k.json"), P.PATTERN, out, length=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 2 and manifest.agg({"n_docs": "sum"}).head()[0] == 400
    starts = sorted((r.start, r.n_tokens) for r in token_files.read_token_files(manifest, out).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_token_files_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_report(df, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_a_worker_gives_memory_back_after_encoding():
    code = """
import numpy as np, pandas as pd, public_tokenizers as P
from millrace.llm import bpe

def rss():
    return int(open("/proc/self/statm").read().split()[1]) * 4 / 1024

def batches():
    r = np.random.default_rng(1)
    for _ in range(2):
        words = r.integers(97, 123, (400, 1000, 6), np.uint8)
        yield pd.DataFrame({"doc_id": range(400), "t": [" ".join(bytes(w).decode() for w in ws) for ws in words]})

path = P.path("byte_bpe_50k.tiktoken")
bpe.load(path, P.PATTERN)
body = lambda b, pdf: len(list(b.pieces.each(pdf["t"].tolist())))
before = rss()
assert list(bpe.each_batch(path, P.PATTERN, body, batches())) == [400, 400]
print(rss() - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(got.stdout) < 60
