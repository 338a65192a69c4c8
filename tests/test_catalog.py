"""Every query of the catalog against its SQL on the smallest tables."""

import glob
import os
import re
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple("nan" if isinstance(v, float) and v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0


def _common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return row[-1]


def test_similarities_of_all_pairs_are_those_of_a_plain_loop(spark, tmp_path):
    items = {0: "one two three four", 1: "alpha beta gamma", 2: ""}
    texts = ["two four", "beta, alpha!", "x", "three one two", "gamma", None, "one two three four", "", "", "five", "alpha beta gamma delta"]
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sims, rouges = {}, {}
    for i, x in enumerate(texts):
        g, p = (re.findall("[a-z]+", y or "") for y in (items[i % 3], x))
        a, b = " ".join(g), " ".join(p)
        sims[i % 3, i] = round(200 * _common(a, b) / (len(a) + len(b))) if a and b else 0
        n = _common(g, p)
        q, r = (100 * n / len(p), 100 * n / len(g)) if g and p else (0, 0)
        rouges[i % 3, i] = q, r, 2.44 * q * r / (r + 1.44 * q) if n else 0
    got = catalog.queries()["edit_sim_indel"](spark, str(tmp_path)).collect()
    assert {(x.item_id, x.doc_id): x.sim for x in got} == sims and len(got) == len(texts)
    got = catalog.queries()["rouge_l"](spark, str(tmp_path)).collect()
    assert {(x.item_id, x.doc_id) for x in got} == set(rouges) and len(got) == len(texts)
    for x in got:
        assert (x.p, x.r, x.f) == pytest.approx(rouges[x.item_id, x.doc_id], abs=1e-6)


def equals_sql_on(spark, folder, name, **made):
    """Whether a query over made tables (SQL of their rows) returns what its own SQL does."""
    c = duckdb.connect()
    for table, sql in made.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = c.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    return plain(catalog.queries()[name](spark, str(folder)).select(columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", ["method_lookup_by_op", "call_edges"])
def test_ids_of_many_parts_and_of_interfaces_differ(spark, tmp_path, name):
    assert equals_sql_on(spark, tmp_path, name, part="SELECT unnest(range(0, 16) || range(999992, 1000008) || range(4999996, 5000012) || range(6000000, 6000004)) AS p_partkey")


def test_evaluation_set_of_over_a_million_rows_is_whole(spark, tmp_path):
    assert equals_sql_on(spark, tmp_path, "capped_evaluation", orders="SELECT i AS o_orderkey, i // 3 AS o_custkey FROM range(1510000) t(i)", customer="SELECT i AS c_custkey FROM range(505000) t(i)")


@pytest.mark.parametrize("name, table, order", [("streamed_sessions", "conversations", "turn"), ("streamed_changes", "events", "ts")])
def test_streams_of_tables_in_several_files(spark, sf, tmp_path, duck, name, table, order):
    # the rows of one key lie in several files, the later ones in earlier files
    spark.read.parquet(f"{sf}/{table}.parquet").coalesce(1).sortWithinPartitions(F.desc(order)).write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/{table}.parquet")
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert plain(catalog.queries()[name](spark, str(tmp_path)).select(columns).collect()) == plain(want.fetchall())


def test_offsets_of_a_long_text_end_in_time(spark, tmp_path):
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert equals_sql_on(spark, tmp_path, "padded_grams_and_shifts", conversations="SELECT 1 AS conv_id, i AS turn, repeat('ab cd ', [0, 1, 64, 10000][i + 1]) AS text FROM range(4) t(i)")
    finally:
        late.cancel()
