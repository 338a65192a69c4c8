"""A corpus pipeline of five stages over documents: rules, near duplicates, repeats, mix, tokens.

Every stage gets all rows that the stage before has kept, as a written table. All but the last return the columns of
documents. A stage's scratch tables are deleted when the next stage begins, since its result is written by then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, common, jaccard, mixing, quality_rules, suffix_dedup

#: SQL can express neither near duplicates by pruned similarity, nor suffix arrays, nor BPE.
ORACLE_SQL = None

#: Scratch tables of the last stage over each folder of tables.
_used: dict[str, list[str]] = {}


def _begin(spark: SparkSession, sf_dir: str) -> set[str]:
    for path in _used.pop(sf_dir, []):
        common.drop_path(spark, path)
    return set(common.scratch_paths())


def _end(sf_dir: str, before: set[str], out: DataFrame) -> DataFrame:
    _used[sf_dir] = [p for p in common.scratch_paths() if p not in before]
    return out


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    before = _begin(spark, sf_dir)
    return _end(sf_dir, before, quality_rules.quality_filter(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    before = _begin(spark, sf_dir)
    return _end(sf_dir, before, jaccard.one_of_each(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated strings."""
    before = _begin(spark, sf_dir)
    return _end(sf_dir, before, suffix_dedup.without_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    before = _begin(spark, sf_dir)
    return _end(sf_dir, before, mixing.mixed(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens): ids as little-endian unsigned 32-bit integers."""
    before = _begin(spark, sf_dir)
    return _end(sf_dir, before, bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("mixing sources", mix), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
