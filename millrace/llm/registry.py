"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from millrace.llm import bpe, embeddings, jaccard, mixing, quality_classifier, quality_rules, suffix_dedup, token_files, toxicity, url_filter
from millrace.llm.common import table


def op1_token_files(spark, sf_dir):
    return token_files.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard.similarity_join(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_embeddings(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_token_files, op2_quality_classifier, op3_quality_rules, op4_toxicity, op5_mixing, op6_suffix_dedup, op7_jaccard_join, op8_url_filter, op9_bpe, op10_embeddings)}


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return whole | {"op3_quality_rules": quality_rules.SQL, "op5_mixing": mixing.SQL, "op8_url_filter": url_filter.SQL}
