import random

import numpy as np
import pytest

from millrace.llm import embeddings, url_filter


def brute(rows):
    good, near = {}, {i: set() for i, _, _ in rows}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        good[i] = (x / np.sqrt(x @ x), label)
    for i, (x, a) in good.items():
        for j, (y, b) in good.items():
            if i < j and a == b and len(x) == len(y) and x @ y >= 0.98:
                near[i].add(j)
                near[j].add(i)
    of = {}
    for i in sorted(near):
        stack = [i]
        while stack:
            if (k := stack.pop()) not in of:
                of[k] = i
                stack += near[k]
    return {i: (len(near[i]), of[i]) for i in near}


def vectors(seed=1):
    r = np.random.default_rng(seed)
    rows = [None, [], [0.0] * 8, [1.0, None] * 4, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [1e-30] * 8, [3e38] * 8, [-0.0] + [1.0] * 7, [0.0] + [1.0] * 7]
    for _ in range(60):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 8)):
            rows.append((base + r.normal(size=8) * r.choice([0, 0.05, 0.08, 0.15])).astype(np.float32).tolist())
    rows += [rows[-1]] * 40 + [[1.0, 2.0, 3.0]] * 3
    labels = [None if k % 17 == 0 else int(k % 2) if k < 300 else 1 for k in range(len(rows))]
    return [(k, v, n) for k, (v, n) in enumerate(zip(rows, labels))]


@pytest.mark.parametrize("per_cell, block", [(2000, 1024), (10, 9)])
def test_vectors_are_brute_force(spark, monkeypatch, per_cell, block):
    monkeypatch.setattr(embeddings, "PER_CELL", per_cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == brute(rows)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_the_small_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_kmeans_centres_are_unit():
    x = embeddings.unit(np.random.default_rng(3).normal(size=(500, 16)))
    c = embeddings.spherical_kmeans(x, 10)
    assert c.shape == (10, 16) and np.allclose((c * c).sum(axis=1), 1)
    assert (x @ c.T).max(axis=1).mean() > (x @ x[:10].T).max(axis=1)[10:].mean()


URLS = [
    (None, "", "", None),
    ("nothing", "", "", None),
    ("http://A.Org", "a.org", "", None),
    ("http://A.ORG/", "a.org", "/", "org/"),
    ("x://Example.Org/es/1?q#f", "example.org", "/es/1", "example.org/es/"),
    ("https://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1"),
    ("https://myexample.org/en/12", "myexample.org", "/en/12", "org/"),
    ("https://example.org?x=/es/", "example.org", "", None),
    ("http://É.com/fr/#x://y", "É.com", "/fr/", "com/fr/"),
    ("http://b.com/de/x", "b.com", "/de/x", "com/de/"),
    ("http://b.com/DE/x", "b.com", "/DE/x", None),
    ("http://c.net/x\ny?z", "c.net", "/x\ny", None),
    ("http://d.net/x", "d.net", "/x", None),
    ("http://good.net/", "good.net", "/", None),
    ("://", "", "", None),
]


def test_url_rules_and_propagation(spark):
    html = {9: '<a href="http://b.com/1">', 11: "<A HREF='//B.com/de'> <a href=/own> ", 12: '<a href="https://c.net">', 3: 'href="http://good.net"', 13: None}
    df = spark.createDataFrame([(k, u, html.get(k, "<p>"), 1) for k, (u, *_) in enumerate(URLS)], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for k, (_, host, path, rule) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
    # c.net links to the blocked b.com, d.net to c.net; a.org, which is trusted, links to good.net
    assert {k: got[k].verdict for k in (0, 3, 4, 9, 10, 11, 12, 13)} == {0: "allow", 3: "allow", 4: "block", 9: "block", 10: "block", 11: "block", 12: "block", 13: "allow"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_ranks_are_those_of_a_plain_loop(spark):
    r = random.Random(2)
    hosts = [f"h{k}" for k in range(30)]
    links = {(r.choice(hosts), r.choice(hosts)): r.randrange(1, 5) for _ in range(120)}
    links = {k: w for k, w in links.items() if k[0] != k[1]}
    pages = spark.createDataFrame([(a, "".join(f'<a href="http://{b}/">' * w)) for (a, b), w in links.items()], "host string, html string")
    seed = {("h1", "trust"): 700, ("h2", "trust"): 300, ("h3", "distrust"): 10**12}
    got = {(x.host, x.kind): x.rank for x in url_filter.spread(spark.createDataFrame([(*k, v) for k, v in seed.items()], "host string, kind string, seed long"), url_filter.edges(pages)).collect()}
    rank = dict(seed)
    for _ in range(url_filter.ROUNDS):
        new = {k: v * 15 // 100 for k, v in seed.items()}
        for kind in ("trust", "distrust"):
            e = {(a, b) if kind == "trust" else (b, a): w for (a, b), w in links.items()}
            of = {}
            for (a, _), w in e.items():
                of[a] = of.get(a, 0) + w
            for (a, b), w in e.items():
                if (a, kind) in rank:
                    new[b, kind] = new.get((b, kind), 0) + rank[a, kind] * 85 * w // (of[a] * 100)
        rank = new
    assert got == rank


def test_distrust_goes_as_far_as_links(spark):
    n = 14
    rows = [(0, "http://b.com/de/x", "")] + [(k, f"http://h{k}.net/", f'<a href="http://{"b.com" if k == 1 else f"h{k - 1}.net"}/">') for k in range(1, n)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "block" for k in range(n)}


def test_settled_ranks_are_those_of_a_plain_loop(spark):
    edge = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("a", "d", 1), ("d", "e", 5)]
    seed = {"a": 900, "c": 100}
    of = {}
    for a, _, w in edge:
        of[a] = of.get(a, 0) + w
    want, rank = None, {k: v * 15 // 100 for k, v in seed.items()}
    while rank != want:
        want = rank
        rank = {k: v * 15 // 100 for k, v in seed.items()}
        for a, b, w in edge:
            rank[b] = rank.get(b, 0) + want.get(a, 0) * 85 * w // (of[a] * 100)
    made = spark.createDataFrame([(a, b, "trust", w, of[a]) for a, b, w in edge], "src string, dst string, kind string, w long, of long")
    got = url_filter.settled(spark.createDataFrame([(k, "trust", v) for k, v in seed.items()], "host string, kind string, seed long"), made)
    assert {r.host: r.rank for r in got.collect()} == {k: v for k, v in want.items() if v}
    # seeds of few pages among many keep a rank to pass on
    many = spark.createDataFrame([("a", "allow")], "host string, given string").union(spark.range(999).selectExpr("'b'", "'allow'"))
    assert {r.host: r.seed for r in url_filter.seeds(many, url_filter.FINE).collect()} == {"a": 10**15, "b": 999 * 10**15}


def test_repeated_vectors_count_once(spark):
    v, near, far = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, v, 1), (1, v, 1), (2, near, 1), (3, far, 1), (3, [0.0, 0.01, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(tuple(r) for r in embeddings.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


def test_labels_have_cells_of_their_own(spark, monkeypatch):
    fitted = []
    plain = embeddings.spherical_kmeans
    monkeypatch.setattr(embeddings, "spherical_kmeans", lambda x, k: fitted.append((len(x), k)) or plain(x, k))
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=6).tolist(), k % 3 if k < 90 else 7) for k in range(95)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.count() == 95 and fitted == [(30, 2)] * 3
