"""Splits, evaluation places and samples, all by explicit orders so that runs agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import is_assertion
from millrace.operators.filters import runtime_valid


def seeded(key: str | Column, seed: int = 7) -> Column:
    """A fixed shuffle: order by it."""
    return F.xxhash64(F.lit(seed), key)


def splits(tests: DataFrame, repos: DataFrame, on: str = "proj_name", split: str = "sources") -> DataFrame:
    """tests with the split of their project; projects without metadata are dropped."""
    return tests.join(repos.select(on, split), on)


def split_ids(tests: DataFrame, split: str = "sources", key: str = "id") -> DataFrame:
    return tests.groupBy(split).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def limited(df: DataFrame, split: str, order: Sequence[str | Column], limits: dict[str, int]) -> DataFrame:
    """At most so many rows of each split; splits without a limit are kept whole."""
    rank = F.row_number().over(Window.partitionBy(split).orderBy(*order))
    most = F.lit(None).cast("int")
    for name, n in limits.items():
        most = F.when(F.col(split) == name, F.lit(n)).otherwise(most)
    return df.withColumn("rank_", rank).where(most.isNull() | (F.col("rank_") <= most)).drop("rank_")


def places(tests: DataFrame, key: str = "id", stmts: str = "test_stmt_toks", first_assertion: bool = False, min_stmt: int = 0, runtime: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(key, stmt_i, carry) of candidate statements. With first_assertion only the first assertion of a test, which
    min_stmt may still drop."""
    if runtime is not None:
        tests = tests.where(runtime_valid(F.col(runtime), F.col(stmts)))
    rows = tests.select(key, *carry, F.posexplode(stmts).alias("stmt_i", "toks_"))
    if first_assertion:
        rows = rows.where(is_assertion(F.col("toks_"))).groupBy(key, *carry).agg(F.min("stmt_i").alias("stmt_i"))
    return rows.select(key, *carry, "stmt_i").where(F.col("stmt_i") >= min_stmt)


def round_robin(rows: DataFrame, key: str, pick: Sequence[str | Column], place: Sequence[str | Column], most: int | None, group: str | None = None, per_group: int | None = None) -> DataFrame:
    """One row of each key per round, in the order `pick` within a key and `place` among keys, until `most` rows (all
    of them if it is None); at most per_group rows of a group."""
    out = rows.withColumn("round_", F.row_number().over(Window.partitionBy(key).orderBy(*pick)))
    if group is not None and per_group is not None:
        out = out.withColumn("in_group_", F.row_number().over(Window.partitionBy(group).orderBy("round_", *place))).where(F.col("in_group_") <= per_group).drop("in_group_")
    out = out.orderBy("round_", *place)
    return (out if most is None else out.limit(most)).drop("round_")


def cut_off(tests: DataFrame, k: str | Column, per_stmt: Sequence[str], per_state: Sequence[str] = ()) -> DataFrame:
    """Rows cut to their first k statements: k elements of each array by statement, k + 1 of each by state."""
    k = F.col(k) if isinstance(k, str) else k
    return tests.withColumns({c: F.slice(c, F.lit(1), k) for c in per_stmt} | {c: F.slice(c, F.lit(1), k + 1) for c in per_state})


def evaluation_set(tests: DataFrame, chosen: DataFrame, key: str = "id", stmts: str = "test_stmt_toks", insns: str | None = None, per_stmt: Sequence[str] = (), per_state: Sequence[str] = ()) -> DataFrame:
    """One row for each chosen place: the test cut before it, with the statement there as gold."""
    rows = tests.join(chosen.select(key, "stmt_i"), key).withColumn("gold_stmts", F.get(stmts, F.col("stmt_i")))
    if insns is not None:
        rows = rows.withColumn("gold_insns", F.get(insns, F.col("stmt_i")))
    return cut_off(rows, "stmt_i", [*per_stmt, stmts], per_state)


def training_rows(tests: DataFrame, stmts: str = "test_stmt_toks", seed: int = 42, key: str = "id") -> DataFrame:
    """One statement of each test, picked by a hash."""
    n = F.size(stmts)
    return tests.where(n > 0).withColumn("stmt_i", F.pmod(seeded(key, seed), n).cast("int"))


def validation_rows(tests: DataFrame, stmts: str = "test_stmt_toks") -> DataFrame:
    """One row for each (test, statement)."""
    return tests.where(F.size(stmts) > 0).withColumn("stmt_i", F.explode(F.sequence(F.lit(0), F.size(stmts) - 1)))
