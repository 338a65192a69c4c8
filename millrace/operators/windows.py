"""Features of ordered sequences (statements of a test, events of a user) as windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import saved

Order = Sequence[str | Column]


def _upto(keys: Sequence[str], order: Order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def last_known(df: DataFrame, keys: Sequence[str], order: Order, value: str | Column, name: str) -> DataFrame:
    """The last value at or before each row that isn't null."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_upto(keys, order)))


def changes(df: DataFrame, keys: Sequence[str], order: Order, value: str) -> DataFrame:
    """Rows whose value differs from the one before, and first rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = df.withColumns({"had_": F.lag(F.lit(1)).over(w), "before_": F.lag(value).over(w)})
    return before.where(F.col("had_").isNull() | ~F.col("before_").eqNullSafe(F.col(value))).drop("had_", "before_")


def full_state(df: DataFrame, group: str, step: str, name: str, value: str) -> DataFrame:
    """(group, step, name, value): at every step of a group, the last value of each name so far."""
    # numbered without gaps, so that a span is as long as the steps that it shows at
    steps = df.select(group, step).distinct().withColumn("at_", F.row_number().over(Window.partitionBy(group).orderBy(step)))
    latest = df.groupBy(group, step, name).agg(F.max_by(value, step).alias(value))
    last = steps.groupBy(group).agg(F.max("at_").alias("last_"))
    spans = latest.join(steps, [group, step]).join(last, group).select(group, name, value, "last_", F.col("at_").alias("from_"))
    until = F.coalesce(F.lead("from_").over(Window.partitionBy(group, name).orderBy("from_")) - 1, F.col("last_"))
    shown = spans.withColumn("until_", until).select(group, name, value, F.explode(F.sequence("from_", "until_")).alias("at_"))
    return shown.join(steps, [group, "at_"]).select(group, step, name, value)


def previous_context(df: DataFrame, keys: Sequence[str], order: Order, tokens: str, size: int = 2, reset: Column | None = None, name: str = "context") -> DataFrame:
    """Tokens of the up to `size` rows before each row; a row for which reset holds begins a new segment after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if reset is not None:
        before = F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("segment_", F.coalesce(before, F.lit(0)))
        w = Window.partitionBy(*keys, "segment_").orderBy(*order)
    out = df.withColumn(name, F.flatten(F.collect_list(tokens).over(w.rowsBetween(-size, -1))))
    return out.drop("segment_")


def set_by_step(n_steps: DataFrame, first_set: DataFrame, every: DataFrame, key: str, name: str) -> DataFrame:
    """(key, step, names_set, names_notset) for steps 0 (before the first statement) to n.

    first_set: (key, name, step) of the steps at which names are set; every: (key, name)."""
    first = first_set.groupBy(key, name).agg(F.min("step").alias("first_"))
    steps = n_steps.select(key, F.explode(F.sequence(F.lit(0), F.col("n"))).alias("step"))
    rows = steps.join(every.select(key, name).distinct(), key, "left").join(first, [key, name], "left")
    done = F.col("first_").isNotNull() & (F.col("first_") <= F.col("step"))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c & F.col(name).isNotNull(), F.col(name))))
    return rows.groupBy(key, "step").agg(pick(done).alias("names_set"), pick(~done).alias("names_notset"))


def types_absent(n_steps: DataFrame, wanted: DataFrame, local: DataFrame, focal_step: DataFrame, key: str = "id") -> DataFrame:
    """(key, step, absent): wanted types without those that a statement before the step has as locals; none after a
    statement that calls the focal method. local: (key, step, type); focal_step: (key, step)."""
    seen = local.groupBy(key, "type").agg((F.min("step") + 1).alias("gone_"))
    called = focal_step.groupBy(key).agg((F.min("step") + 1).alias("called_"))
    steps = n_steps.select(key, F.explode(F.sequence(F.lit(0), F.col("n"))).alias("step"))
    rows = steps.join(wanted.select(key, "type").distinct(), key, "left").join(seen, [key, "type"], "left").join(called, key, "left")
    there = F.col("type").isNotNull() & (F.col("gone_").isNull() | (F.col("step") < F.col("gone_"))) & (F.col("called_").isNull() | (F.col("step") <= F.col("called_")))
    return rows.groupBy(key, "step").agg(F.array_sort(F.collect_list(F.when(there, F.col("type")))).alias("absent"))


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, first: str, last: str, width: int | None = None) -> DataFrame:
    """Points with the spans of the same keys that hold them. With a width, spans and points meet by buckets of it
    besides, so that one key's rows are spread."""
    inside = (F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last))
    if width is None:
        return points.join(spans, list(keys)).where(inside)
    cut = spans.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    return points.withColumn("bucket_", F.floor(F.col(at) / width)).join(cut, [*keys, "bucket_"]).where(inside).drop("bucket_")


def lines_overlap(df: DataFrame, keys: Sequence[str], order: Order, first: str = "first", last: str = "last", control: str | None = None) -> DataFrame:
    """df with overlaps: whether a row begins at or before the last line of the row before. For control-flow rows it
    counts only if it begins before that line, or on it right after a statement."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(last).over(w)
    plain = F.col(first) <= before
    if control is None:
        return df.withColumn("overlaps", F.coalesce(plain, F.lit(False)))
    strict = (F.col(first) < before) | ((F.col(first) == before) & ~F.lag(control).over(w))
    return df.withColumn("overlaps", F.coalesce(F.when(F.col(control), strict).otherwise(plain), F.lit(False)))


def renumbered(df: DataFrame, order: Order, name: str = "new_id", prefix: str | None = None) -> DataFrame:
    """Dense numbers from 0 over all rows in order, without one task for all rows: rows are range-partitioned, numbered
    in their partitions, and shifted by the sizes of those before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, since a second run might draw the boundaries elsewhere
    dealt = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "numbered")
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).collect()  # one row a partition
    shift, total_ = {}, 0
    for r in sorted(sizes, key=lambda r: r["part_"]):
        shift[r["part_"]], total_ = total_, total_ + r["n_"]
    offset = F.lit(0).cast("long")
    if shift:
        table = F.create_map(*(F.lit(x) for kv in shift.items() for x in kv))
        offset = F.element_at(table, F.col("part_")).cast("long")
    number = F.col("at_") + offset
    return dealt.withColumn(name, F.concat(F.lit(prefix), number.cast("string")) if prefix is not None else number).drop("part_", "at_")


def chunks(df: DataFrame, keys: Sequence[str], order: Order, size: int, name: str = "chunk") -> DataFrame:
    return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("int"))


def next_op(df: DataFrame, keys: Sequence[str], order: Order, op: str, skip: Sequence[str] = ("LABEL",), end: str = "END") -> DataFrame:
    """The next operation after each row that isn't to be skipped; past the end, `end`."""
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("next_op", F.coalesce(F.first(F.when(~F.col(op).isin(*skip), F.col(op)), ignorenulls=True).over(after), F.lit(end)))


def unseen_literals(df: DataFrame, keys: Sequence[str], order: Order, literals: str, values: str) -> DataFrame:
    """Values of each row that no row before it has as a literal."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = df.withColumn("seen_", F.flatten(F.collect_list(literals).over(before)))
    return seen.withColumn("nontrivial", F.array_except(values, F.coalesce("seen_", F.array().cast("array<string>")))).drop("seen_")
