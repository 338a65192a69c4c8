"""Summaries of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.base import nan, safe_ratio


def summaries(value: str | Column, prefix: str = "") -> list[Column]:
    """AVG, SUM, MAX, MIN, MEDIAN, STDEV (of the population), MODE (the smallest of the most frequent) and CNT of
    values that aren't null; NaN (0 for the count) where there are none."""
    v = F.col(value) if isinstance(value, str) else value
    of = lambda x: F.when(F.count(v) > 0, x.cast("double")).otherwise(nan())
    median = F.when(F.count_if(F.isnan(v.cast("double"))) > 0, nan()).otherwise(F.median(v))
    named = {"AVG": F.avg(v), "SUM": F.sum(v), "MAX": F.max(v), "MIN": F.min(v), "MEDIAN": median, "STDEV": F.stddev_pop(v), "MODE": F.mode(v, deterministic=True)}
    return [*(of(x).alias(prefix + k) for k, x in named.items()), F.count(v).alias(prefix + "CNT")]


def collected(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    """(metric, values) of a map column; rows without a metric don't count."""
    return df.select(F.explode(metrics).alias("metric", "value")).groupBy("metric").agg(F.collect_list("value").alias("values"))


def means(df: DataFrame, metrics: str = "metrics") -> DataFrame:
    return df.select(F.explode(metrics).alias("metric", "value")).groupBy("metric").agg(F.avg("value").alias("mean"))


def rich(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(*summaries(value))


def described(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation of the sample, extremes and exact quartiles."""
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))
    return df.groupBy(*(group or [])).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(v).alias("max"))


def overlap_features(df: DataFrame, feature: str, others: list[str]) -> DataFrame:
    """Numbers of a feature's tokens and distinct tokens, and how many of the latter each other set has, with shares."""
    distinct = F.array_distinct(feature)
    out = {f"st_{feature}": F.size(feature), f"stu_{feature}": F.size(distinct), f"present_{feature}": F.size(feature) > 0}
    for o in others:
        n = F.size(F.array_intersect(feature, o))
        out |= {f"o_{feature}_{o}": n, f"fo_{feature}_{o}": safe_ratio(n, F.size(distinct))}
    return df.withColumns(out)


def missing_tokens(gold: Column, given: Column) -> Column:
    return F.array_except(gold, given)


def lowest(df: DataFrame, score: str, place: str, n: int = 10) -> DataFrame:
    return df.orderBy(score, place).limit(n)


def vocabulary_top(df: DataFrame, kind: str, token: str, place: str, k: int) -> DataFrame:
    """(kind, token, n, rank): the k most frequent tokens of each kind; of equal ones the later comes first."""
    n = df.groupBy(kind, token).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first_"))
    w = Window.partitionBy(kind).orderBy(F.col("n").desc(), F.col("first_").desc(), F.col(token).desc())
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first_")


def duplicate_weights(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, sequence, weight): distinct sequences of each key with their numbers."""
    return df.groupBy(key, sequence).agg(F.count(F.lit(1)).alias("weight"))


def self_pairs(df: DataFrame, group: str, item: str, value: str, metric) -> DataFrame:
    """(group, mean): mean of metric over ordered pairs of different items within a group."""
    a, b = df.select(group, F.col(item).alias("i"), F.col(value).alias("x")), df.select(group, F.col(item).alias("j"), F.col(value).alias("y"))
    return a.join(b, group).where("i != j").groupBy(group).agg(F.avg(metric(F.col("x"), F.col("y"))).alias("mean"))


def merged_metrics(first: DataFrame, second: DataFrame) -> DataFrame:
    """(metric, values) of two sets of collected metrics: lists of one metric are put end to end."""
    both = first.select("metric", "values", F.lit(0).alias("k_")).unionByName(second.select("metric", "values", F.lit(1).alias("k_")))
    return both.groupBy("metric").agg(F.flatten(F.array_sort(F.collect_list(F.struct("k_", "values")))["values"]).alias("values"))


def nearest_texts(asked: DataFrame, known: DataFrame, by: list[str], text: str, k: int = 10) -> DataFrame:
    """(asked's columns, found, distance, rank): the k texts of the same keys at the least edit distance."""
    pairs = asked.join(known.select(*by, F.col(text).alias("found")).distinct(), by)
    scored = pairs.withColumn("distance", F.levenshtein(text, "found"))
    w = Window.partitionBy(*asked.columns).orderBy("distance", "found")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
