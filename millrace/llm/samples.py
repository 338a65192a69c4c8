"""Bounded samples of labelled rows, and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def first_by_hash(rows: DataFrame, most: int, id: str = "doc_id", n: int | None = None) -> DataFrame:
    """At most `most` rows, as a fixed choice that doesn't depend on how the rows lie. Where there are more, hashes
    thin them out first, so that the sort gets little more than `most` rows from all tasks together."""
    n = rows.count() if n is None else n
    h = F.xxhash64(id)
    if n > 2 * most:
        rows = rows.where(F.pmod(h, F.lit(1_000_000_000)) < int(1_200_000_000 * most / n) + 1)
    return rows.orderBy(h, id).limit(most)
