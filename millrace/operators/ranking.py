"""Ranked predictions: joins with gold, reranking, subsets and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, group: str | list[str], score: str | Column, place: str | Column) -> DataFrame:
    """The row of each group with the largest score, the first of equal ones."""
    keys = [group] if isinstance(group, str) else group
    score = F.col(score) if isinstance(score, str) else score
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), place))).where("rank_ = 1").drop("rank_")


def subset(to: DataFrame, source: DataFrame, keys: tuple[str, ...] = ("data_id", "stmt_i")) -> DataFrame:
    """to's places (pos, keys) with source's predictions at the first place of the same keys; raises if one is missing."""
    first = source.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in source.columns if c not in keys)), "pos").alias("found"))
    out = to.join(first, list(keys), "left")
    return out.withColumn("found", F.when(F.col("found").isNull(), F.raise_error(F.lit("a place has no prediction"))).otherwise(F.col("found")))


def first_success(values: Column, wanted: int = 100) -> Column:
    """1-based place of the first element that equals wanted; 0 if there is none or no array."""
    return F.coalesce(F.array_position(values, wanted), F.lit(0)).cast("int")


def chosen_rank(runnable: Column, compilable: Column) -> Column:
    """0-based place of the first runnable prediction, else of the first compilable one, else 0."""
    run, compiles = first_success(runnable), first_success(compilable)
    return F.when(run > 0, run - 1).when(compiles > 0, compiles - 1).otherwise(0)


def move_to_front(values: Column, k: Column) -> Column:
    return F.when(k > 0, F.concat(F.slice(values, k + 1, F.lit(1)), F.slice(values, F.lit(1), k), F.slice(values, k + 2, F.greatest(F.size(values) - k - 1, F.lit(0))))).otherwise(values)


def rerank(preds: DataFrame, runs: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """preds with each of the lists led by the chosen prediction; rows without a run pass through."""
    joined = preds.join(runs, keys, "left").withColumn("chosen", chosen_rank(F.col("topk_runnable"), F.col("topk_compilable")))
    return joined.withColumns({c: move_to_front(F.col(c), F.col("chosen")) for c in lists})


def merged_parts(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Predictions of several ranks; of one id the last rank's counts."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part_", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return best_row(out, key, "part_", key).drop("part_")


def ids_complete(df: DataFrame, key: str = "id") -> DataFrame:
    """(n, complete): whether ids are 0 to n - 1."""
    return df.agg(F.count(F.lit(1)).alias("n"), ((F.coalesce(F.max(key), F.lit(-1)) + 1 == F.count(F.lit(1))) & (F.count_distinct(key) == F.count(F.lit(1)))).alias("complete"))


def top_k(df: DataFrame, group: str, score: str, place: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), place)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def paired(gold: DataFrame, preds: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows at equal places; a place that one side lacks is an error."""
    both = gold.join(preds, pos, "full")
    return both.withColumn(pos, F.when(F.col("has_gold_").isNull() | F.col("has_pred_").isNull(), F.raise_error(F.lit("lengths differ"))).otherwise(F.col(pos))) if {"has_gold_", "has_pred_"} <= set(both.columns) else paired(gold.withColumn("has_gold_", F.lit(True)), preds.withColumn("has_pred_", F.lit(True)), pos).drop("has_gold_", "has_pred_")


def runtime_metrics(preds: DataFrame) -> DataFrame:
    """compilable and runnable of the first prediction, 0 where unknown."""
    return preds.withColumns({"compilable": F.coalesce(F.get("topk_compilable", 0), F.lit(0)), "runnable": F.coalesce(F.get("topk_runnable", 0), F.lit(0))})


def beams(lines: DataFrame, column: str = "value", separator: str = " <SEP> ") -> DataFrame:
    """(pos, rank, toks) of lines whose candidates are separated."""
    cut = F.split(F.col(column), separator.replace("<", r"\<").replace(">", r"\>"))
    return lines.select("pos", F.posexplode(cut).alias("rank", "text")).select("pos", "rank", F.filter(F.split(F.trim("text"), " "), lambda x: x != "").alias("toks"))
