"""Ordered filter cascades with a reason for each rejected row and a counter for each reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.metrics import occurrences
from millrace.functions.names import has_flag

# Fixed value: names that say nothing.
BAD_NAME = r"^[tT][eE][sS][tT]_?\d*$"
# Default limits of the cascade.
LIMITS = {"min_stmts": 1, "max_stmts": 20, "min_focal": 1, "max_focal": 200, "max_all": 400, "max_stmt": 100, "max_rows": 10_000}


def reject_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that rejects a row, else null."""
    chain = F.lit(None).cast("string")
    for name, rejects in reversed(list(rules)):
        chain = F.when(F.coalesce(rejects, F.lit(False)), F.lit(name)).otherwise(chain)
    return chain


def cascade(df: DataFrame, rules: Sequence[tuple[str, Column]], column: str = "reject_reason") -> DataFrame:
    return df.withColumn(column, reject_reason(rules))


def kept(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    return df.where(reject_reason(rules).isNull())


def counters(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(reason, n) of every rule, also of those that reject nothing."""
    spark = df.sparkSession
    names = spark.createDataFrame([(n,) for n, _ in rules], "reason string")
    n = df.select(reject_reason(rules).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def test_rules(limits: dict | None = None) -> list[tuple[str, Column]]:
    """The cascade over test methods: columns name, ptypes, rtype, has_ast, has_bytecode, node_types, focal_mid,
    mapping_error, test_stmt_toks, test_sign_toks, focalm_toks, has_control_flow, insn_toks."""
    m = LIMITS | (limits or {})
    stmts = F.size("test_stmt_toks")
    everything = F.size("focalm_toks") + F.size("test_sign_toks") + F.size(F.flatten("test_stmt_toks"))
    return [
        ("badly_named", F.col("name").rlike(BAD_NAME)),
        ("has_parameters", F.size("ptypes") > 0),
        ("not_void", F.col("rtype") != "void"),
        ("no_code", ~F.col("has_ast") | ~F.col("has_bytecode")),
        ("local_class", F.array_contains("node_types", "LocalClassDeclarationStmt")),
        ("no_focal_method", F.col("focal_mid").isNull()),
        ("mapping_error", F.col("mapping_error")),
        ("too_few_stmts", stmts < m["min_stmts"]),
        ("too_many_stmts", stmts > m["max_stmts"]),
        ("focal_too_short", F.size("focalm_toks") < m["min_focal"]),
        ("focal_too_long", F.size("focalm_toks") > m["max_focal"]),
        ("too_long", everything > m["max_all"]),
        ("stmt_too_long", F.exists("test_stmt_toks", lambda s: F.size(s) > m["max_stmt"])),
        ("control_flow", F.col("has_control_flow")),
        ("invokedynamic", F.array_contains("insn_toks", "INVOKEDYNAMIC")),
    ]


def size_between(df: DataFrame, group: str, least: int = 1, most: int | None = None, order: Sequence[str | Column] = ()) -> DataFrame:
    """Rows of groups with at least so many rows, at most so many of each, the first in the given order."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_n_")).where(F.col("group_n_") >= least)
    out = df.join(n, group)
    if most is not None:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        # groups within the limit need no order
        over = out.where(F.col("group_n_") > most).withColumn("rank_", rank).where(F.col("rank_") <= most).drop("rank_")
        out = out.where(F.col("group_n_") <= most).unionByName(over)
    return out.drop("group_n_").select(df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank_ = 1").drop("rank_")


def last_wins(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return first_wins(df, keys, [F.col(position).desc()])


def allowed(df: DataFrame, names: DataFrame, key: str, deny: bool = False) -> DataFrame:
    return df.join(names.select(key).distinct(), key, "left_anti" if deny else "left_semi")


def source_small_enough(code: Column, chars: int = 100_000, lines: int = 1000) -> Column:
    return (F.length(code) <= chars) & (F.size(F.split(code, "\n")) <= lines)


def repository_ok(license_type: Column, licenses: Sequence[str], build_system: Column, n_tests: Column) -> Column:
    return license_type.isin(*licenses) & build_system.isNotNull() & (n_tests > 0)


def runtime_valid(delta: Column, stmts: Column) -> Column:
    return delta.isNotNull() & (F.size(delta) == F.size(stmts) + 1)


def degenerate(tokens: Column, most: int = 10) -> Column:
    """Whether some token comes at least so often."""
    return F.exists(occurrences(tokens), lambda x: x["c"] >= most)


def selected_models(models: DataFrame, tags: Sequence[str], existing: DataFrame, need: str = "missing") -> DataFrame:
    """Models with one of the tags whose predictions exist or are missing; assertion and reranked ones are left out."""
    own = models.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))) & ~F.arrays_overlap("tags", F.array(F.lit("assert"), F.lit("rerank"))))
    return own.join(existing.select("model").distinct(), "model", "left_anti" if need == "missing" else "left_semi")


def similar_enough(score: Column, least: float = 1.0) -> Column:
    return F.coalesce(score >= least, F.lit(False))


def stars_enough(stars: Column, least: int = 0) -> Column:
    """Unknown numbers of stars count as none."""
    return F.coalesce(stars, F.lit(0)) >= least


def short_enough(tokens: Column, most: int = 200) -> Column:
    return F.size(tokens) <= most


def visible(access: Column, scope: Column, class_name: Column) -> Column:
    """What a scan keeps: all of a project's own members, none of a library's private ones, of the platform's only the
    public and protected ones of its known packages."""
    shown = ~has_flag(access, "private")
    known = class_name.rlike(r"^(java|javax|org)\.")
    return F.when(scope == "LIB", shown).when(scope == "JRE", known & (has_flag(access, "public") | has_flag(access, "protected"))).otherwise(F.lit(True))


def is_code_module(packaging: Column, path: Column) -> Column:
    """Modules below the root that are packaged as a jar."""
    return (packaging == "jar") & (path != ".")


def recent(epoch_seconds: Column, least: int = 1577836800) -> Column:
    """At or after a moment (by default the begin of 2020); unknown ones aren't."""
    return F.coalesce(epoch_seconds >= least, F.lit(False))


def status_totals(df: DataFrame, status: str, name: str) -> DataFrame:
    """(status, n, names): projects of each outcome, by name."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(name)).alias("names"))
