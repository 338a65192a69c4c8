import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_classifier as qc
from millrace.llm import toxicity
from millrace.llm.samples import fold


def corpus(n=900, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(2, 9)))
    insults = ["grumble", "wretch", "nitwit"]
    docs, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(r.randrange(40, 200))]
        toxic = i % 5 == 0
        bad = i % 7 == 0
        if toxic:
            for _ in range(r.randrange(2, 6)):
                ws[r.randrange(len(ws))] = r.choice(insults)
        if bad:
            ws = [w.upper() + "!!" for w in ws] if i % 2 else [w + " |" for w in ws]
        docs.append((i, " ".join(ws), "x", 0.5))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (n + 1, "", None, None), (n + 2, "word " * 30000, "", 0.0)]
    labels += [(None, 1, 1), (n + 9, 1, 0), (5, None, None)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, held_out string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label, folds, out", [(qc.score, "quality", 4, 2), (toxicity.score, "toxic", 3, 1)])
def test_held_out_accuracy(tables, score, label, folds, out):
    docs, labels = tables
    got = score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds == out for i in got["doc_id"]]).all()
    known = got.merge(labels.where(f"{label} is not null").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert len(held) > 80 and (held["predicted"] == held[label]).mean() > 0.95
    again = score(docs.repartition(3), labels.repartition(2)).toPandas().set_index("doc_id")["score"]
    assert np.allclose(again.sort_index().to_numpy(), got.set_index("doc_id")["score"].sort_index().to_numpy(), atol=1e-6)


@pytest.mark.parametrize("score", [qc.score, toxicity.score])
def test_labels_of_held_out_rows_are_not_learnt(tables, score):
    docs, labels = tables
    out = (fold(F.col("doc_id"), 4) == 2) if score is qc.score else (fold(F.col("doc_id"), 3) == 1)
    turned = labels.withColumns({c: F.when(out, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    a, b = (score(docs, x).toPandas().set_index("doc_id")["score"].sort_index() for x in (labels, turned))
    assert np.allclose(a.to_numpy(), b.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("score", [qc.score, toxicity.score])
def test_odd_tables(tables, score):
    docs, labels = tables
    assert score(docs.limit(0), labels).count() == 0
    assert {r.score for r in score(docs.limit(5), labels.limit(0)).collect()} == {0.0}


def test_index_equals_brute_force():
    r = np.random.default_rng(1)
    vectors = []
    for _ in range(500):
        t = np.sort(r.choice(200, r.integers(0, 12), replace=False))
        vectors.append((t.astype(np.int64), r.integers(1, 5, len(t))))
    index = toxicity.Index(vectors, r.integers(0, 2, 500), 200)
    dense = np.zeros((500, 200))
    for k, (t, c) in enumerate(vectors):
        dense[k, t] = index.weigh(t, c)
    for _ in range(200):
        t = np.sort(r.choice(200, r.integers(1, 15), replace=False)).astype(np.int64)
        c = r.integers(1, 4, len(t))
        q = np.zeros(200)
        q[t] = index.weigh(t, c)
        cos = dense @ q
        got, near = index.nearest(t, c)
        assert len(got) == min(toxicity.NEIGHBOURS, (cos > 0).sum())
        assert np.allclose(near, np.sort(cos)[::-1][: len(got)]) and np.allclose(cos[got], near)


def test_grams_are_those_of_a_plain_loop():
    texts = ["", "abc", "Abcd efgh", "é" * 9, "zzzzzzzzzz"]
    code, owner = toxicity.grams(texts)
    want = sum(max(0, len(t.lower().encode()) - k + 1) for t in texts for k in toxicity.LENGTHS)
    assert len(code) == want
    vocabulary = toxicity.Vocabulary(np.unique(code))
    for t, (terms, counts) in zip(texts, vocabulary.count(texts)):
        raw = t.lower().encode()
        grams = [raw[i : i + k] for k in toxicity.LENGTHS for i in range(len(raw) - k + 1)]
        assert len(terms) == len(set(grams)) and counts.sum() == len(grams)


def test_prior_of_a_known_mixture():
    r = np.random.default_rng(2)
    pos, neg = r.normal(2, 1, 4000), r.normal(-2, 1, 4000)
    unl = np.concatenate([pos[:1200], neg[:2800]])
    assert abs(qc.estimate_prior(r.normal(2, 1, 4000), unl) - 0.3) < 0.06


def test_every_word_of_the_examples_is_a_term(spark):
    # each insult is in few of the examples, so no test of significance would find it
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(2, 4)))
    docs, labels = [], []
    for i in range(1200):
        ws = [word() for _ in range(r.randrange(40, 60))]
        if i % 4 == 0:
            ws[3:3] = ["klmnopqrstuvwxyz"[i // 4 % 16] * 9 + "klmnopq"[i // 64 % 7] * 9] * 3
        docs.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 == 0)))
    got = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [x for x in got if x.held_out]
    assert np.mean([x.predicted == (x.doc_id % 4 == 0) for x in held]) > 0.95
    assert all(x.evidence for x in held)
    # a clean text's neighbours are those by all its words, not only by toxic ones
    clean = next(x for x in held if x.doc_id % 4)
    bags = {i: toxicity.counted([t])[0] for i, t in docs}
    chosen = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    df = {}
    for i in chosen:
        for w in bags[i][0].tolist():
            df[w] = df.get(w, 0) + 1
    vector = lambda i: {w: (1 + np.log(c)) * (np.log((1 + len(chosen)) / (1 + df.get(w, 0))) + 1) for w, c in zip(*(x.tolist() for x in bags[i]))}
    q = vector(clean.doc_id)
    norm = lambda v: sum(x * x for x in v.values()) ** 0.5
    cos = sorted((sum(x * q.get(w, 0) for w, x in v.items()) / norm(v) / norm(q) for v in map(vector, chosen)), reverse=True)
    assert np.allclose([e.cosine for e in clean.evidence], cos[:10])


def test_words_are_those_of_a_plain_split():
    texts = ["", "  ", "One two, ONE_two! \u00c9t\u00e9\u3002", "a" * 300 + " b", "\u4e2d\u6587 x\u4e2d"]
    got = toxicity.counted(texts)
    assert [c.sum() for _, c in got] == [0, 0, 5, 2, 4]
    assert [len(t) for t, _ in got] == [0, 0, 3, 2, 3]
    assert set(toxicity.counted(["two one"])[0][0]) < set(got[2][0])


def test_prior_is_fitted_on_the_whole_sample():
    # the later half of the positives lies in cell 1
    pos = np.repeat([0, 1], 3000)[:, None]
    unl = np.tile([0, 1, 2, 2, 2, 2], 1000)[:, None]
    p, _ = qc.fit_logistic_prior(pos, unl, 3)
    assert abs(p[0] - p[-1]) < 0.1


def test_blocks_below_the_bound_are_not_scored():
    # two groups of examples without common terms: a text of one never scores blocks of the other
    r = np.random.default_rng(5)
    vectors = [(np.append(0, 1 + np.sort(r.choice(49, 11, replace=False))) + 50 * (k % 2), r.integers(1, 4, 12)) for k in range(640)]
    index = toxicity.Index(vectors, r.integers(0, 2, 640), 100)
    dense = np.zeros((640, 100))
    for k, (t, c) in enumerate(vectors):
        dense[k, t] = index.weigh(t, c)
    for k in range(60):
        t, c = vectors[k]
        got, near = index.nearest(t, c)
        cos = dense @ dense[k]
        assert got[0] == k and np.allclose(near, np.sort(cos)[::-1][:10])
        scored = index.scores(t, index.weigh(t, c), 10)[1]
        assert scored.sum() <= index.n_blocks / 2 + 1
        skipped = ~scored[index.place // toxicity.BLOCK]
        assert skipped.any() and cos[skipped].max(initial=0) <= near[-1] + 1e-9


@pytest.mark.parametrize("score, label", [(qc.score, "quality"), (toxicity.score, "toxic")])
def test_rows_of_a_repeated_id_are_one_example(spark, score, label):
    docs = [(7, f"word{k} text") for k in range(300)] + [(k, "good words here" if k % 2 else "bad things there") for k in range(60)]
    labels = [(k, k % 2) for k in range(60)]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    got = score(a, spark.createDataFrame(labels, f"doc_id long, {label} int"), folds=50, held_out=49)
    assert got.count() == 360


@pytest.mark.parametrize("n", [1, 31, 700])
def test_index_of_frequent_and_rare_terms_equals_brute_force(n):
    # terms 0-9 are in a third of the examples, the others in a few; every third example repeats one before
    r = np.random.default_rng(n)
    vectors = []
    for k in range(n):
        t = np.flatnonzero(np.concatenate([r.random(10) < 0.4, r.random(900) < 0.02]))
        vectors.append(vectors[k // 2] if k % 3 == 2 else (t, r.integers(1, 5, len(t))))
    index = toxicity.Index(vectors, r.integers(0, 2, n), 910)
    dense = np.zeros((n, 910))
    for k, (t, c) in enumerate(vectors):
        dense[k, t] = index.weigh(t, c)
    asked = [*vectors[:150], (np.array([0, 909]), np.array([1, 1])), (toxicity.NONE, toxicity.NONE)]
    for without in (None, np.arange(len(asked))):
        for k, (got, near) in enumerate(index.nearest_of([(*x, toxicity.NONE) for x in asked], without=without)):
            q = np.zeros(910)
            q[asked[k][0]] = index.weigh(*asked[k])
            cos = np.round(dense @ q, 13)
            if without is not None and k < n:
                cos[k] = 0
            want = [i for i in np.lexsort((np.arange(n), -cos)) if cos[i] > 0][:10]
            assert np.allclose(near, cos[want]) and np.allclose(cos[got], near) and len(set(got)) == len(got)
