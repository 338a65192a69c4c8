"""The method that a test is about, from the calls it makes in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def focal_class_name(test_class: Column) -> Column:
    """The tested class by the test class's name: without Test at its end, or else at its beginning."""
    package = F.regexp_extract(test_class, r"^(.*\.)?", 0)
    name = F.substring(test_class, F.length(package) + 1, F.length(test_class))
    return F.concat(package, F.when(name.endswith("Test"), F.regexp_replace(name, "Test$", "")).otherwise(F.regexp_replace(name, "^Test", "")))


def focal_methods(calls: DataFrame, key: str = "id", focal_class: str | None = "focal_cid") -> DataFrame:
    """(key, mid, rule) from calls (key, i, mid, cid, scope, has_code, is_assertion[, focal_cid]).

    Among calls of application methods with code: the only one; the only one in the focal class, or its last before
    the first assertion; the last before the first assertion; the last. Tests without such calls are left out.
    The focal class must itself be application code; it is null where unknown."""
    mine = (F.col("scope") == "APP") & F.col("has_code")
    first_assertion = calls.groupBy(key).agg(F.min(F.when(F.col("is_assertion"), F.col("i"))).alias("stop"))
    rows = calls.where(mine).join(first_assertion, key)
    early = F.col("stop").isNull() | (F.col("i") < F.col("stop"))
    in_class = F.lit(False) if focal_class is None else F.coalesce(F.col("cid") == F.col(focal_class), F.lit(False))
    last = lambda cond: F.max(F.when(cond, F.struct("i", "mid")))["mid"]
    per = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), last(F.lit(True)).alias("last"), last(early).alias("last_early"),
        F.count_if(in_class).alias("n_class"), last(in_class).alias("last_class"), last(in_class & early).alias("class_early"),
    )
    rule = (
        F.when(F.col("n") == 1, "only")
        .when(F.col("n_class") == 1, "only_in_class")
        .when((F.col("n_class") > 1) & F.col("class_early").isNotNull(), "class_before_assertion")
        .when(F.col("last_early").isNotNull(), "before_assertion")
        .otherwise("last")
    )
    mid = F.when(rule.isin("only", "last"), F.col("last")).when(rule == "only_in_class", F.col("last_class")).when(rule == "class_before_assertion", F.col("class_early")).otherwise(F.col("last_early"))
    return per.select(key, mid.alias("mid"), rule.alias("rule"))
