"""Small building blocks for lazily evaluated array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column, kind: str = "double") -> Column:
    """Sum of an array; 0 for an empty one."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def sums(values: Column, kind: str = "int", block: int = 128) -> Column:
    """0 and the sums of the first 1, 2, ... elements: one more than there are elements. An array is copied for each
    element that it grows by, so only blocks of the sums are made in that way."""

    def grown(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array((F.element_at(a, -1) + x).cast(kind))))

    def joined(blocks: Column) -> Column:
        starts = grown(F.transform(blocks, lambda b: total(b, kind)), F.lit(0).cast(kind))
        return let(starts, lambda s: F.flatten(F.concat(F.array(F.array(F.lit(0).cast(kind))), F.transform(blocks, lambda b, k: F.slice(grown(b, F.get(s, k)), 2, F.size(b))))))

    return let(values, lambda v: let(F.transform(positions(F.ceil(F.size(v) / block).cast("int")), lambda k: F.slice(v, (k - 1) * block + 1, block)), joined))


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def positions(n: Column) -> Column:
    """1, ..., n; empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def nan() -> Column:
    return F.lit(float("nan"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; NaN where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(nan())


def words(text: Column) -> Column:
    r"""Runs of letters."""
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))
