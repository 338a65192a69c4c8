"""Readers and writers of corpora: Parquet datasets, JSON sections of projects, text and CSV lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

CLASS = "id int, access int, scope string, ext int, impl array<int>, name string, fields array<int>, methods array<int>"
FIELD = "id int, access int, clz int, name string, type string"
METHOD = "id int, access int, clz int, is_test boolean, name string, ptypes array<string>, rtype string, ttypes array<string>, atypes array<string>, code string, ast string, bytecode struct<insns:map<string,array<string>>,lnt:map<string,int>>"
PREDICTION = "id int, data_id string, input_stids array<int>, topk array<struct<toks:array<string>,score:double,weight:int>>, topk_insn array<struct<toks:array<string>,score:double,weight:int>>, metrics map<string,double>, time double, misc struct<topk_compilable:array<int>,topk_runnable:array<int>,topk_runtime:array<double>>"


def read_columns(spark: SparkSession, path: str, only: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """A dataset's columns; columns that it lacks are left out."""
    df = spark.read.parquet(path)
    names = [c for c in (only if only is not None else df.columns) if c in df.columns and c not in exclude]
    return df.select(names)


def read_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def read_in_order(df: DataFrame, ids: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    return df.join(ids.select(key, pos), key).orderBy(pos).drop(pos)


def write_columns(df: DataFrame, path: str, append: bool = False, exist_ok: bool = True, only: Sequence[str] | None = None) -> None:
    mode = "append" if append else "overwrite" if exist_ok else "errorifexists"
    (df.select(*only) if only else df).write.mode(mode).parquet(path)


def extend(df: DataFrame, extra: DataFrame, key: str = "id") -> DataFrame:
    """df with the columns of extra, which may lack rows."""
    return df.join(extra, key, "left")


def read_column_files(spark: SparkSession, path: str, fields: dict[str, str], key: str = "id") -> DataFrame:
    """A corpus of one JSON-lines file for each field, whose n-th lines make the n-th row: a join by line numbers."""
    out = None
    for name, kind in fields.items():
        lines = numbered_lines(spark, f"{path}/{name}.jsonl")
        # a JSON value by itself isn't a row: it is read as the field of an object
        value = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), f"v {kind}")["v"]
        column = lines.select("pos", value.alias(name))
        out = column if out is None else out.join(column, "pos")
    return out


def read_project(spark: SparkSession, path: str, proj: str, shared: DataFrame | None = None, schema: str = CLASS, section: str = "class") -> DataFrame:
    """One section of a project's raw data with its name, and the shared rows before it."""
    own = spark.read.schema(schema).json(f"{path}/joint.{section}.json", multiLine=True).withColumn("proj", F.lit(proj))
    return own if shared is None else shared.withColumn("proj", F.lit(proj)).unionByName(own)


def read_call_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, label)."""
    raw = spark.read.schema("edges map<string,array<array<string>>>").json(f"{path}/joint.cg.json", multiLine=True)
    pairs = raw.select(F.explode("edges").alias("src", "to")).select(F.col("src").cast("int").alias("src"), F.explode("to").alias("t"))
    return pairs.select("src", F.get("t", 0).cast("int").alias("dst"), F.get("t", 1).alias("label"))


def read_repositories(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(full_name, source) of list files; the source is the file's stem, of several the last wins."""
    out = None
    for k, p in enumerate(paths):
        stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        part = spark.read.text(p).select(F.trim("value").alias("full_name"), F.lit(stem).alias("source"), F.lit(k).alias("place")).where("full_name != ''")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("full_name").agg(F.max_by("source", "place").alias("source"))


def read_runtime_log(spark: SparkSession, path: str) -> DataFrame:
    from millrace.functions.tokens import log_line

    return spark.read.text(path).select(log_line(F.col("value")).alias("v")).select("v.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of one text file of any size. Lines are numbered within the splits that tasks read, and shifted by
    the sizes of the splits before (one row a split)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split_"), F.monotonically_increasing_id().alias("at_"))
    per = lines.groupBy("split_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("split_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(per.select("split_", "first_", before.alias("before_")), "split_").select((F.col("before_") + F.col("at_") - F.col("first_")).alias("pos"), "value")


def read_scored_csv(spark: SparkSession, path: str) -> DataFrame:
    """The best-scored prediction of each index."""
    rows = spark.read.schema("idxs int, logit_1 double, pred_assertion string").csv(path, header=True, escape='"')
    w = Window.partitionBy("idxs").orderBy(F.col("logit_1").desc(), "pred_assertion")
    return rows.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled; a folder of part files, each with the header."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_predictions(df: DataFrame, path: str) -> None:
    df.orderBy("id").write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str, metrics_only: bool = False) -> DataFrame:
    df = spark.read.schema(PREDICTION).json(path)
    return df.select("id", "metrics") if metrics_only else df


def delta(df: DataFrame, base: int, key: str = "id") -> DataFrame:
    """Rows that a project adds to the shared ones."""
    return df.where(F.col(key) >= base)


def keys_unique(df: DataFrame, key: str = "id") -> bool:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).head()
    return r["n"] == r["d"]


def rows_at(df: DataFrame, places: Sequence[int], pos: str = "pos") -> DataFrame:
    """The rows at some places, in the order asked for; readers skip row groups without them."""
    asked = df.sparkSession.createDataFrame(list(enumerate(places)), f"at_ int, {pos} long")
    return df.where(F.col(pos).isin(*set(places))).join(F.broadcast(asked), pos).orderBy("at_").drop("at_")


def zipped(columns: dict[str, DataFrame], pos: str = "pos") -> DataFrame:
    """Tables of (pos, value) as the columns of one; a place that one of them lacks is an error."""
    out = None
    for name, df in columns.items():
        part = df.select(pos, F.struct(F.col("value").alias(name)).alias(f"{name}_"))
        out = part if out is None else out.join(part, pos, "full")
    missing = F.lit(False)
    for name in columns:
        missing = missing | F.col(f"{name}_").isNull()
    checked = out.withColumn(pos, F.when(missing, F.raise_error(F.lit("columns differ in length"))).otherwise(F.col(pos)))
    return checked.select(pos, *(F.col(f"{n}_")[n].alias(n) for n in columns))


def listed(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows given one by one, with their places."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"pos long, {schema}")


def used_projects(preds: DataFrame, data: DataFrame, data_id: str = "data_id", key: str = "id", project: str = "proj_name") -> DataFrame:
    """The projects that predictions are about."""
    return data.join(preds.select(F.col(data_id).alias(key)).distinct(), key, "left_semi").select(project).distinct()


def classpath(parts: Sequence[DataFrame], name: str = "name") -> DataFrame:
    """Classes of several places as one table: of one name, the first place's counts."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("place_", F.lit(k))
        out = p if out is None else out.unionByName(p)
    w = Window.partitionBy(name).orderBy("place_")
    return out.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_", "place_")


def read_stream(spark: SparkSession, path: str, schema: str | StructType, files: str = "*.parquet", per_batch: int | None = 1) -> DataFrame:
    """A folder's files as a stream, so many a batch; None: all that are there."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)).parquet(path)


def progress(query: StreamingQuery) -> tuple[int, int]:
    """(batches, rows) that a stream has read so far."""
    batches = [p for p in query.recentProgress if p["numInputRows"] > 0]
    return len(batches), sum(p["numInputRows"] for p in batches)
