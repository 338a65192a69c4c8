"""Connected components of edge tables by alternating large and small stars.

Every round is two joins and two aggregations that combine on the map side; a hub with any share of the edges
is a skewed join that Spark splits, never a group in one task. Rounds are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_path, saved


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(id, component) of every id in edges: the smallest id that it reaches. Edges with a null end are left out."""
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    now = saved(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        before = now
        now = saved(_small_star(_large_star(now)), "edges")
        for path in {f.rsplit("/", 1)[0] for f in before.inputFiles()}:
            drop_path(spark, path)
        last, state = state, _state(now)
        if last == state:
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join deals it out anew and Spark can split a hub's side of it
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    tied = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return tied.distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them. e holds u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
