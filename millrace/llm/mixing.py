"""Mixing sources to target weights by systematic sampling.

Sources weigh 5, 2, 1, repeating in the order of their names by code point (null last), and share as many
words as all documents have; a target stops at MAX_REPEAT times its source's words, the excess goes to the
others by weight until none is above. Then each document of a source expects so many copies: those that hold a large
part of the target (LARGE, and LARGE_OF_SOURCE of the source, so that they are few) whole numbers, chosen from the
largest on so that the words taken follow the share wanted, since a chance for one of them would move the source far
from its target; all others the same number, which makes up the rest of the target. The expectations are summed up
along the source's documents, in whole billionths so that no order of summation matters, one offset for all sources is
added, and a document is emitted once for each whole number that its stretch of the sum crosses: no document exceeds
MAX_REPEAT copies, and as the documents lie in the order of their size classes, the words taken stay near the target.

A source that holds any share of the rows is no hot group: the running sums are taken in buckets
(size class, hash of doc_id modulo the number of slices, which grows with the rows), and a bucket's start comes from
the few totals of the buckets.

Defined results: a null text has size 0; documents of size 0 in a source without words are not taken; a
null source is a source of its own; an empty table gives an empty table; repeated rows are sampled one by
one; other columns pass through. Reruns agree.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import saved, words

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
UNIT = 1_000_000_000
#: Rows of all sources for which a size class gets another slice, and the fewest slices.
PER_SLICE = 250_000
LEAST_SLICES = 64
#: A document is large if it has more than one LARGE-th of its source's target and one LARGE_OF_SOURCE-th of its words.
LARGE = 100
LARGE_OF_SOURCE = 1000
SEED = 20
OFFSET = random.Random(SEED).randrange(UNIT)


def size_of(text: Column) -> Column:
    return F.size(words(text.cast("string"))).cast("long")


def targets(per: DataFrame, source: str = "source", weights=WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size). The windows run over one row a source."""
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    weighed = per.select(source, "source_size", weigh.alias("w"))
    # in the order in which growing shares reach the caps: what is left for each source and those after it
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col(source).asc_nulls_last())
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.withColumns({"lw": F.sum("source_size").over(everything) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0)), "lv": F.sum("w").over(rest)})
    # the first source that its share doesn't fill; it and all after it get that share
    free = F.col("lw") * F.col("w") <= most * F.col("source_size") * F.col("lv")
    at = lambda c: F.first(F.when(free, F.col(c)), True).over(everything)
    share = (F.col("w") * at("lw")).cast("double") / at("lv").cast("double")
    return left.select(source, "source_size", F.least((most * F.col("source_size")).cast("double"), share).alias("target"))


def large_copies(sizes: Column, rate: Column, most: int) -> Column:
    """(place, copies, size) of documents of these sizes, largest first: each gets the whole number that brings the
    words taken so far nearest to rate times the words so far."""

    def step(acc: Column, size: Column) -> Column:
        seen = acc["seen"] + size
        n = F.least(F.greatest(F.floor((rate * seen - acc["taken"]) / size + 0.5), F.lit(0)), F.lit(most)).cast("long")
        plan = F.concat(acc["plan"], F.array(F.struct((F.size(acc["plan"]) + 1).alias("place"), n.alias("copies"), size.alias("size"))))
        return F.struct(seen.alias("seen"), (acc["taken"] + n * size).alias("taken"), plan.alias("plan"))

    zero = F.lit(0).cast("long")
    return F.aggregate(sizes, F.struct(zero.alias("seen"), zero.alias("taken"), F.array().cast("array<struct<place:int,copies:bigint,size:bigint>>").alias("plan")), step, lambda x: x["plan"])


def _slice(key: Column, size: Column, rows: int) -> Column:
    """A hash of key (of the size where it is null) modulo the number of slices, by whole numbers that SQL has too."""
    hashed = F.pmod(F.coalesce(key, size), F.lit(1_000_003)) * 7919 % 1_000_003
    return (hashed % max(LEAST_SLICES, rows // PER_SLICE)).cast("int")


def copies(df: DataFrame, carried: list[str], text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, most: int = MAX_REPEAT, offset: int = OFFSET) -> DataFrame:
    """(row, size, source_size, target, copies) of each row of df: row has the carried columns, copies how often the
    mix takes it."""
    row = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row")
    sized = df.select(row, F.col(key).alias("k"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("s"), size_of(F.col(text)).alias("size"))
    bucket = ["s", "cls", "sub"]
    sized = sized.withColumns({"cls": F.length(F.bin("size")), "sub": _slice(F.col("k"), F.col("size"), df.count()), "tie": F.xxhash64("row")})
    # a row for each bucket: sources x size classes x SLICES at most
    per = saved(sized.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix")
    goal = per.groupBy("s").agg(F.sum("words").alias("source_size")).select(F.expr("nullif(s, '')").alias("s"), "source_size")
    goal = saved(targets(goal, "s", weights, most).withColumn("s", F.coalesce("s", F.lit(""))), "targets")
    is_large = (F.col("size") * LARGE > F.col("target")) & (F.col("size") * LARGE_OF_SOURCE > F.col("source_size"))
    known = sized.join(goal, "s")
    # at most LARGE_OF_SOURCE rows a source
    place = F.row_number().over(Window.partitionBy("s").orderBy(F.col("size").desc(), "k", "tie"))
    large = saved(known.where(is_large).withColumn("place", place), "large")
    plan = large.groupBy("s").agg(F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.array_sort(F.collect_list(F.struct("place", "size"))).alias("x"))
    plan = plan.select("s", F.explode(large_copies(F.col("x.size"), F.col("target") / F.col("source_size").cast("double"), most)).alias("p")).select("s", "p.*")
    done = plan.groupBy("s").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.sum("size").alias("large_words"))
    begun = large.groupBy(bucket).agg(F.count(F.lit(1)).alias("n_large"))
    start = F.coalesce(F.sum(F.col("n") - F.coalesce("n_large", F.lit(0))).over(Window.partitionBy("s").orderBy("cls", "sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # every other document of a source expects the same, so a running sum is that times a running count
    left = F.col("target") - F.coalesce("taken", F.lit(0)).cast("double")
    rest = (F.col("source_size") - F.coalesce("large_words", F.lit(0))).cast("double")
    each = F.when(rest > 0, F.floor(F.least(F.greatest(left / rest, F.lit(0.0)), F.lit(float(most))) * UNIT)).otherwise(0).cast("decimal(12,0)")
    begin = per.join(begun, bucket, "left").select(*bucket, start.alias("start")).join(goal.join(done, "s", "left").select("s", "source_size", "target", each.alias("each")), "s")
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("size", "k", "tie")).cast("long")
    small = known.where(~is_large).drop("source_size", "target").withColumn("rank", rank).join(begin, bucket).select("row", "size", "source_size", "target", (F.col("start") + F.col("rank")).alias("upto"), "each")
    crossed = lambda n: F.floor((n.cast("decimal(18,0)") * F.col("each") + offset) / UNIT).cast("long")
    small = small.select("row", "size", "source_size", "target", (crossed(F.col("upto")) - crossed(F.col("upto") - 1)).alias("copies"))
    return small.union(large.join(plan.select("s", "place", "copies"), ["s", "place"]).select("row", "size", "source_size", "target", "copies"))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of df as many times as it is taken, with df's columns."""
    taken = copies(df, df.columns, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_report(df: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row."""
    return copies(df, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[i % 3 + 1]::BIGINT AS w FROM s),
q AS (SELECT *, sum(source_size) OVER () - {MAX_REPEAT} * coalesce(sum(source_size) OVER b, 0) AS lw,
        sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lv, row_number() OVER (ORDER BY source_size / w, i) AS o FROM w
      WINDOW b AS (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lw::DOUBLE AS lw, lv::DOUBLE AS lv FROM q WHERE lw * w <= {MAX_REPEAT} * source_size * lv ORDER BY o LIMIT 1),
t AS (SELECT i, source, source_size, least(({MAX_REPEAT} * source_size)::DOUBLE, (w * f.lw) / f.lv) AS target FROM q, f),
a AS (SELECT d.*, t.i, source_size, target, size * {LARGE} > target AND size * {LARGE_OF_SOURCE} > source_size AS large FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
l AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY size DESC, doc_id) AS place FROM a WHERE large),
g(i, place, seen, taken, copies) AS (
  SELECT i, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM t
  UNION ALL
  SELECT i, place, seen, (taken + copies * size)::BIGINT, copies FROM (
    SELECT g.i, l.place, g.seen + l.size AS seen, g.taken, l.size,
      least(greatest(floor((l.target / l.source_size::DOUBLE * (g.seen + l.size) - g.taken) / l.size + 0.5), 0), {MAX_REPEAT})::BIGINT AS copies
    FROM g JOIN l ON l.i = g.i AND l.place = g.place + 1)),
e AS (SELECT i, max_by(taken, place) AS taken, max(seen) AS seen FROM g GROUP BY i),
r AS (SELECT a.*, row_number() OVER (PARTITION BY a.i ORDER BY length(bin(size)), coalesce(doc_id, size) % 1000003 * 7919 % 1000003 % (SELECT greatest({LEAST_SLICES}, count(*) // {PER_SLICE}) FROM documents), size, doc_id) AS n,
        CASE WHEN source_size - seen > 0 THEN floor(least(greatest((target - taken) / (source_size - seen)::DOUBLE, 0.0), {MAX_REPEAT}.0) * {UNIT}) ELSE 0 END::HUGEINT AS e
      FROM a JOIN e USING (i) WHERE NOT large)
SELECT doc_id, size, source_size, target, (((n * e + {OFFSET}) // {UNIT} - ((n - 1) * e + {OFFSET}) // {UNIT}) * size)::BIGINT AS taken FROM r
UNION ALL
SELECT doc_id, size, source_size, target, g.copies * size FROM l JOIN g USING (i, place)
"""
