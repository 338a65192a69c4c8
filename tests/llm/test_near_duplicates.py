import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import blocks, jaccard
from millrace.llm.components import components


def shingles(t):
    ws = (t or "").encode().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def brute(rows):
    """doc_id -> (n_links, component) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    near = {i: set() for i, _ in rows}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                near[i].add(j)
                near[j].add(i)
    component = {}
    for i in sorted(near):
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in component:
                component[k] = i
                stack += near[k]
    return {i: (len(near[i]), component[i]) for i in near}


def near_copies(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 6)))
    rows = [None, "", "  ", "one two", "one two", "one  two\n", "two one", "a b c d e", "a b c d e"]
    for _ in range(25):
        base = [word() for _ in range(r.randrange(30, 300))]
        for _ in range(r.randrange(1, 9)):
            ws = list(base)
            for _ in range(r.randrange(0, 5)):
                ws[r.randrange(len(ws))] = word()
            rows.append(" ".join(ws))
    # a passage that many share, and a large group of near copies
    passage = " ".join(word() for _ in range(60))
    rows += [" ".join(word() for _ in range(150)) + " " + passage for _ in range(30)]
    base = [word() for _ in range(200)]
    for k in range(60):
        ws = list(base)
        ws[k], ws[-k - 1] = word(), word()
        rows.append(" ".join(ws))
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [400, 7])
def test_similarity_join_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies()
    df = spark.createDataFrame([(*x, "c", 5) for x in rows], "doc_id long, text string, class_id string, n int").repartition(6)
    got = {r.doc_id: r for r in jaccard.similarity_join(df).collect()}
    want = brute(rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_similarity_join_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.similarity_join(spark.createDataFrame([], schema)).count() == 0
    t = "a b c d e f g"
    df = spark.createDataFrame([(None, t), (None, None), (4, t), (4, t), (4, "other words"), (9, t), (10, None)], schema)
    got = sorted(map(tuple, jaccard.similarity_join(df).collect()), key=str)
    assert len(got) == 7 and [x for x in got if x[0] is None] == [(None, None, 0, None, False)] * 0 + [x for x in got if x[0] is None]
    assert [(x[3], x[4]) for x in got if x[0] == 9] == [(4, False)]
    assert sorted(r.doc_id or -1 for r in jaccard.one_of_each(df).collect()) == [-1, -1, 4, 4, 10]


def test_posterior_pruning_keeps_pairs_above_the_threshold():
    need = jaccard.fewest_matches(0.8, 1e-9)
    assert need[40] < need[280] < 0.8 * 280
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 3000, np.uint64)
    kept = 0
    for _ in range(60):
        a = np.unique(base[:900])
        b = np.unique(np.concatenate([base[100:900], base[900 + 100 : 1000 + 100]]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = jaccard.similar_pairs([a, b], np.array([0, 1]), None)
        kept += len(got[0])
        assert (len(got[0]) == 1) == (j >= 0.8)
    assert kept == 0 or kept == 60


def test_intersections_by_matrix():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 5000, r.integers(1, 900), np.uint64)) for _ in range(30)]
    ii, jj = np.triu_indices(30, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(ii, jj)]
    assert jaccard.intersections(sets, ii, jj).tolist() == want


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 470)] + [(500, k) for k in range(501, 560)] + [(None, 3), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots():
    assert blocks.roots(6, np.array([5, 2, 1]), np.array([2, 4, 3])).tolist() == [0, 1, 2, 1, 2, 2]


def test_groups_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select((F.col("id") % 13).alias("g"), "id")
        body = lambda p: p.groupby("g", as_index=False)["id"].agg(["sum", "count"]).rename(columns={"sum": "s", "count": "n"})[["g", "s", "n"]]
        got = {r.g: (r.s, r.n) for r in blocks.by_group(df, ["g"], body, "g long, s long, n long").collect()}
        assert got == {g: (sum(range(g, 200, 13)), len(range(g, 200, 13))) for g in range(13)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_rows_count_once(spark):
    base = [f"w{k}" for k in range(60)]
    t, near = " ".join(base), " ".join([*base[:-1], "other"])
    rows = [(4, t), (4, t), (5, near), (None, t), (4, near), (6, "something else"), (6, t)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_links, r.component_id) for r in jaccard.similarity_join(df.where("not (doc_id = 4 and text like '%other')").where("doc_id < 6")).collect()}
    assert got == {(4, 1, 4), (5, 1, 4)}
    # rows that share doc_id and text are one, others stay
    left = jaccard.one_of_each(df)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(4, t), (4, near), (0, t), (6, "something else")])


def test_one_of_each_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "row", "sha", "component", "c1"]
    df = spark.createDataFrame([(1, "a b c d e f", "r", "s", "x", 1), (2, "a b c d e f", "r", "s", "x", 2)], "doc_id long, text string, row string, sha string, component string, c1 int")
    left = jaccard.one_of_each(df)
    assert left.columns == names and [tuple(r) for r in left.collect()] == [(1, "a b c d e f", "r", "s", "x", 1)]
