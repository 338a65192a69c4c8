import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from millrace.llm import mixing
from millrace.llm.pretokens import load_ranks
from tests.llm.test_near_duplicates import brute as near
from tests.llm.test_rules_and_mixing import counted
from tests.llm.test_suffix_dedup import brute as repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghijkl", k=r.randrange(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = [None, "", "short text", "x y z " * 50]
    for k in range(40):
        ws = [word() for _ in range(r.randrange(60, 160))]
        rows.append(" ".join(ws))
        if k % 4 == 0:
            ws[3] = word()
            rows += [" ".join(ws), " ".join(ws)]
        if k % 5 == 0:
            rows.append(" ".join(word() for _ in range(80)) + " " + passage + " é " + " ".join(word() for _ in range(50)))
    return [(i, t, "en", [None, "a", "b", "c"][i % 4] if i % 3 else "hot", len(t or "")) for i, t in enumerate(rows)]


def test_pipeline_is_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        stages.append({i: [] for i in ()})
        stages[-1] = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    def passes(t):
        n, chars, symbols, dup, again = counted(t)
        return not (n < 50 or 100 * again > 50 * n or 100 * symbols > 10 * n or 10 * chars < 25 * n or 10 * chars > 120 * n or 10 * dup > n)

    want = [(x[0], x[1]) for x in rows if passes(x[1])]
    assert sorted(r.doc_id for r in stages[0]) == [i for i, _ in want] and 40 < len(want) < len(rows)
    groups = near(want)
    want = [(i, t) for i, t in want if groups[i][1] == i]
    assert sorted(r.doc_id for r in stages[1]) == [i for i, _ in want]
    cut = {i: w[4].decode(errors="ignore") for (i, _), w in zip(want, repeats([t for _, t in want]))}
    assert {r.doc_id: r.text for r in stages[2]} == cut and any(len(cut[i]) < len(t) for i, t in want)
    assert all(r.n_chars == len(r.text) for r in stages[2])
    expected = {r.doc_id: r.taken // r.size for r in mixing.mix_report(spark.read.parquet(f"{tmp_path}/2.parquet")).collect() if r.size}
    taken = {}
    for r in stages[3]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
        assert r.text == cut[r.doc_id]
    assert taken == {i: n for i, n in expected.items() if n}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert len(stages[4]) == len(stages[3])
    for r in stages[4]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(cut[r.doc_id]) and r.n_tokens == len(r.ids) // 4
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stages[4]))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
