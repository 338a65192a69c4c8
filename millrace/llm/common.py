"""Helpers shared by the corpus operators: tables, scratch space and text expressions."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a class for regular expressions and as characters for translate().
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_scratch: list[str] = []


def scratch_paths() -> list[str]:
    """Scratch paths that this process has made and not deleted."""
    return list(_scratch)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='millrace-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one if all runs on this machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts its lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _scratch:
        _scratch.remove(path)


def drop_table(df: DataFrame) -> None:
    """Deletes a table that saved() has written, and lets Spark drop the shuffles of queries that have ended."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(spark, path)
    spark._jvm.System.gc()


def release() -> None:
    """Returns what a Python worker has freed to the system: the worker stays while other stages need memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if its files are read by fewer tasks: work on texts takes longer than moving them.
    Of no effect on inputs of more splits than cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size // split < cores else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once, inside one lazily evaluated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
