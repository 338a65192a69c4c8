"""Prefix indexes as tables of (key array<string>, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.base import positions


def has_prefix(key: Column, prefix: Column) -> Column:
    return F.slice(key, 1, F.size(prefix)) == prefix


def with_prefix(trie: DataFrame, prefix: list[str]) -> DataFrame:
    p = F.array(*map(F.lit, prefix)) if prefix else F.array().cast("array<string>")
    return trie.where(has_prefix(F.col("key"), p))


def subtrie(trie: DataFrame, prefix: list[str]) -> DataFrame:
    """Keys below prefix, without it."""
    return with_prefix(trie, prefix).withColumn("key", F.slice("key", F.lit(len(prefix) + 1), F.size("key") - len(prefix)))


def updated(trie: DataFrame, changes: DataFrame) -> DataFrame:
    """trie with changes' keys set anew."""
    return trie.join(changes.select("key"), "key", "left_anti").unionByName(changes)


def removed(trie: DataFrame, keys: DataFrame) -> DataFrame:
    return trie.join(keys.select("key"), "key", "left_anti")


def prefixes(trie: DataFrame) -> DataFrame:
    """(prefix, key, value) for each prefix of each key, the whole key included."""
    return trie.select(F.explode(F.transform(positions(F.size("key")), lambda i: F.slice("key", F.lit(1), i))).alias("prefix"), "key", "value")


def prefix_join(queries: DataFrame, trie: DataFrame) -> DataFrame:
    """Queries (query array<string>) with the keys that they are prefixes of: an equi-join on prefixes."""
    return queries.join(prefixes(trie), queries["query"] == F.col("prefix")).drop("prefix")


def within_set(trie: DataFrame, allowed: Column) -> DataFrame:
    """Keys all of whose elements are allowed."""
    return trie.where(F.forall("key", lambda x: F.array_contains(allowed, x)))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Prefixes that both have."""
    return prefixes(a).select("prefix").distinct().intersect(prefixes(b).select("prefix").distinct())
