"""All pairs within groups of any size, in blocks of bounded size.

A group of n rows is cut in ceil(n / most) blocks; every pair of blocks is a unit of work of its own, so a group
that holds any share of the rows is spread over many tasks. No pair becomes a row: a unit counts the links of each
of its rows and joins linked rows to a root."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_pairs(df: DataFrame, n: str, key: str, most: int) -> DataFrame:
    """df with own (the row's block), i and j (a pair of blocks, i <= j), a row for each pair that the row is in."""
    count = F.ceil(F.col(n) / F.lit(most)).cast("int")
    cut = df.withColumn("blocks_", count).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks_")).cast("int"))
    other = cut.withColumn("o_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    return other.withColumns({"i": F.least("own", "o_"), "j": F.greatest("own", "o_")}).drop("blocks_", "o_")


def by_group(df: DataFrame, keys: list[str], body: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """body over each group of rows; groups are read one after the other from sorted partitions."""

    def run(batches: Iterable[pd.DataFrame]):
        held: list[pd.DataFrame] = []
        out: list[pd.DataFrame] = []
        rows = 0

        def close():
            group = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held.clear()
            got = body(group)
            if got is not None and len(got):
                out.append(got)

        for pdf in batches:
            if not len(pdf):
                continue
            values = pdf[keys].to_numpy()
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
            if held and (held[-1][keys].iloc[-1].to_numpy() != values[0]).any():
                close()
            for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                if a:
                    close()
                held.append(pdf.iloc[a:b])
            rows = sum(map(len, out))
            if rows > 5000:
                yield pd.concat(out, ignore_index=True)
                out.clear()
        if held:
            close()
        if out:
            yield pd.concat(out, ignore_index=True)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices reaches by the edges (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def linked(ids: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame | None:
    """(id, links, root) of the rows that have a link; links: weights of the rows linked with them."""
    if not len(a):
        return None
    links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    root = order[roots(len(ids), place[a], place[b])][place]
    at = np.flatnonzero(links > 0)
    return pd.DataFrame({"id": ids[at], "links": links[at].astype(np.int64), "root": ids[root[at]]})
