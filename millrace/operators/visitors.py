"""Functions by node type, and functions over the rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dispatched(node: Column, handlers: dict[str, Callable[[Column], Column]], default: Callable[[Column], Column]) -> Column:
    """What the handler of the node's type makes of it, else what default does."""
    out = default(node)
    for kind, handler in handlers.items():
        out = F.when(node["ast_type"] == kind, handler(node)).otherwise(out)
    return out


def visited(nodes: Column, handlers: dict[str, Callable[[Column], Column]], default: Callable[[Column], Column]) -> Column:
    """Every node of a tree, in pre-order, by its type's handler."""
    return F.transform(nodes, lambda n: dispatched(n, handlers, default))


def processed(df: DataFrame, process: dict[str, Callable[[], Column]]) -> DataFrame:
    """df with columns that are computed where they are read."""
    return df.withColumns({name: make() for name, make in process.items()})


def mapped(df: DataFrame, body: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tasks: int | None = None) -> DataFrame:
    """body over batches of rows, on all executors."""

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            yield body(pdf)

    return (df.repartition(tasks) if tasks else df).mapInPandas(run, schema)
