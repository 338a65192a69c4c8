"""BM25 over an inverted index: one row for each (document, term)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

B, K1 = 0.75, 1.6


def index(docs: DataFrame, key: str = "doc_id", tokens: str = "toks", by: list[str] | None = None) -> DataFrame:
    """(by, key, term, x, idf, length, mean_length): x = count * idf, idf = ln(n / df) + 1; a document's length is the
    sum of its x. by: columns that part the documents into corpora of their own."""
    by = by or []
    tf = docs.select(*by, key, F.explode(tokens).alias("term")).groupBy(*by, key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.select(*by, key).groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))
    joined = tf.join(df, [*by, "term"])
    joined = joined.join(n, by) if by else joined.crossJoin(F.broadcast(n))  # a single row
    idf = F.log(F.col("n_docs") / F.col("df")) + 1
    weighed = joined.select(*by, key, "term", (F.col("tf") * idf).alias("x"), idf.alias("idf"), "n_docs")
    lengths = weighed.groupBy(*by, key).agg(F.sum("x").alias("length"), F.first("n_docs").alias("n_docs"))
    # documents without tokens count in the mean with length 0
    mean = lengths.groupBy(*by).agg((F.sum("length") / F.first("n_docs")).alias("mean_length"))
    lengths = lengths.drop("n_docs").join(mean, by) if by else lengths.drop("n_docs").crossJoin(F.broadcast(mean))
    return weighed.drop("n_docs").join(lengths, [*by, key])


def scores(queries: DataFrame, indexed: DataFrame, query: str = "query_id", key: str = "doc_id", tokens: str = "toks", by: list[str] | None = None, b: float = B, k1: float = K1) -> DataFrame:
    """(by, query, key, score) of documents that share a term with the query; terms of a query count once."""
    by = by or []
    asked = queries.select(*by, query, F.explode(F.array_distinct(tokens)).alias("term"))
    part = F.col("x") * (F.col("idf") - 1) * (k1 + 1) / (F.col("x") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return asked.join(indexed, [*by, "term"]).groupBy(*by, query, key).agg(F.sum(part).alias("score"))


def best(scored: DataFrame, query: str = "query_id", key: str = "doc_id", k: int = 1, digits: int | None = 9) -> DataFrame:
    """The k best documents of each query, equally good ones by key; scores are compared after so many digits."""
    value = F.col("score") if digits is None else F.round("score", digits)
    w = Window.partitionBy(query).orderBy(value.desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_statements(contexts: DataFrame, indexed_context: DataFrame, queries: DataFrame, query: str, key: str, n_tokens: str, by: list[str] | None = None) -> DataFrame:
    """For each query the best other statement, with its score by the query's number of tokens."""
    found = best(scores(queries, indexed_context, query, key, by=by), query, key)
    return queries.join(found.select(query, key, "score"), query, "left").withColumn("score", F.when(F.size(n_tokens) > 0, F.col("score") / F.size(n_tokens)))
