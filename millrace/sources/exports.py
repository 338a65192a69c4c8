"""Texts for other systems: tests with the statement left out, the statement, the tested method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import write_lines

# Placeholders that the other systems expect.
PLACEHOLDER = ["<AssertPlaceHolder>"]
QUOTED_PLACEHOLDER = ['"<AssertPlaceHolder>"', ";"]


def _words(*tokens: str) -> Column:
    return F.array(*map(F.lit, tokens))


def source_text(sign: str, stmts: str, stmt_i: Column, focal: str | None, placeholder: list[str]) -> Column:
    """Signature, statements before stmt_i, the placeholder, and the tested method if wanted."""
    parts = [F.col(sign), _words("{"), F.flatten(F.slice(stmts, F.lit(1), stmt_i)), _words(*placeholder), _words("}")]
    return F.array_join(F.concat(*parts, *([F.col(focal)] if focal else [])), " ")


def method_and_assertion(df: DataFrame, stmt_i: Column, gold: Column, sign: str = "test_sign_toks", stmts: str = "test_stmt_toks", focal: str = "focalm_toks") -> DataFrame:
    """(source, target) of each row."""
    return df.select(source_text(sign, stmts, stmt_i, focal, PLACEHOLDER).alias("source"), F.array_join(gold, " ").alias("target"))


def assertion_samples(df: DataFrame, stmt_i: Column, gold: Column, sign: str = "test_sign_toks", stmts: str = "test_stmt_toks", focal: str = "focalm_toks") -> DataFrame:
    """(assertion, test, fm) of each row, to be written by tables.write_csv with their labels."""
    return df.select(F.array_join(gold, " ").alias("assertion"), source_text(sign, stmts, stmt_i, None, QUOTED_PLACEHOLDER).alias("test"), F.array_join(focal, " ").alias("fm"))


def write_pairs(pairs: DataFrame, path: str, pos: str | None = None) -> None:
    """testMethods and assertLines, whose n-th lines belong together."""
    rows = pairs if pos is None else pairs.orderBy(pos)
    for name, column in (("testMethods", "source"), ("assertLines", "target")):
        write_lines(rows, f"{path}/{name}", column)
