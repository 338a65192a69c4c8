"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

A text is described by counts (FEATURES), each cut at quantiles of the unlabelled sample; a linear model over the
cuts is trained on trusted positives (label 1) and unlabelled texts alone. With class prior p the risk of the negative
class, R_u - p R_p-, is estimated from unlabelled and positive texts; where it falls below zero in a batch, its
gradient is reversed instead, so that it isn't fitted below what any classifier can reach. The prior is estimated from
a first model of positives against unlabelled: the smallest ratio of their shares above a cut of the scores (with a
margin for its spread). Scores are calibrated by a logistic curve on labelled rows outside the held-out fold.

Samples are bounded: SAMPLE trusted positives, SAMPLE unlabelled texts, SAMPLE labelled rows. Defined results: null is
the empty text and gets its score; without positives every score is 0; null labels and null doc_ids aren't learnt
from; repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import spread
from millrace.llm.samples import first_by_hash, fold
from millrace.llm.toxicity import logistic

SAMPLE = 8000
BINS = 12
EPOCHS = 60
BATCH = 512
RATE = 0.05
SEED = 11
FEATURES = ("words", "mean_word", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "distinct", "top_word", "repeated_pairs", "line_words", "dup_lines", "long_words", "punct_words")


def features(t: str) -> tuple[float, ...]:
    raw = t.encode()
    ws = t.split()
    n, chars = max(1, len(ws)), max(1, len(raw))
    count = raw.count
    seen = Counter(ws)
    pairs = Counter(zip(ws, ws[1:]))
    lines = [x for x in t.split("\n") if x.strip()]
    small = t.lower()
    upper = sum(map(str.__ne__, t, small)) if len(small) == len(t) else 0
    return (
        np.log1p(len(ws)),
        len(t) / n,
        upper / chars,
        len(raw) - len(raw.translate(None, b"0123456789")),
        (len(raw) - len(raw.translate(None, b"#*$%&|<>~^=_@\\{}[]"))) / n,
        count(b"|") / n,
        (count(b"!") + count(b"?")) / n,
        count(b".") / n,
        count(b",") / n,
        len(seen) / n,
        (max(seen.values()) if seen else 0) / n,
        (len(ws) - 1 - len(pairs)) / n if len(ws) > 1 else 0.0,
        len(ws) / max(1, len(lines)),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(len(w) > 20 for w in seen) / n,
        sum(w[-1] in string.punctuation for w in seen) / max(1, len(seen)),
    )


class Cuts:
    """One-hot quantile cells of each feature."""

    def __init__(self, x: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") + s for e, c, s in zip(self.edges, x.T, self.start, strict=False)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, n_cells: int, prior: float, seed: int = SEED, beta: float = 0.0, gamma: float = 1.0) -> np.ndarray:
    """Weights (last: intercept) that minimise the non-negative risk of the sigmoid loss, by Adam over batches."""
    r = np.random.default_rng(seed)
    w = np.zeros(n_cells + 1)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0

    def gradient(cells, d):
        g = np.bincount(cells.ravel(), np.repeat(d, cells.shape[1]), n_cells + 1)
        g[-1] = d.sum()
        return g

    batches = max(1, len(unl) // BATCH)
    for _ in range(EPOCHS):
        for p, u in zip(np.array_split(r.permutation(len(pos)), batches), np.array_split(r.permutation(len(unl)), batches), strict=True):
            if not len(p) or not len(u):
                continue
            zp, zu = w[pos[p]].sum(axis=1) + w[-1], w[unl[u]].sum(axis=1) + w[-1]
            sp, su = sigmoid(zp), sigmoid(zu)
            # loss of a text as positive is sigmoid(-z), as negative sigmoid(z)
            negative = su.mean() - prior * sp.mean()
            dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
            g_negative = gradient(unl[u], du) - prior * gradient(pos[p], dp)
            g = -gamma * g_negative if negative < -beta else g_negative - prior * gradient(pos[p], dp)
            g += 1e-4 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Largest share of positives in unl that scores allow: over cuts c, min of P(unl >= c) / P(pos >= c), each with
    two standard errors."""
    cuts = np.unique(np.quantile(pos, np.linspace(0, 0.95, 96)))
    p = np.array([(pos >= c).mean() for c in cuts])
    u = np.array([(unl >= c).mean() for c in cuts])
    upper = u + 2 * np.sqrt(u * (1 - u) / len(unl)) + 1 / len(unl)
    lower = np.maximum(p - 2 * np.sqrt(p * (1 - p) / len(pos)) - 1 / len(pos), 1e-6)
    return float(np.clip((upper / lower)[p >= 0.05].min(), 0.02, 0.98))


def fit_logistic_prior(pos: np.ndarray, unl: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of positives and unlabelled texts by a model that tells them apart."""
    both = np.vstack([pos, unl])
    x = np.zeros((len(both), n_cells))
    np.add.at(x, (np.arange(len(both))[:, None], both), 1)
    y = np.concatenate([np.ones(len(pos)), np.zeros(len(unl))])
    w = logistic(x, y, np.ones(len(y)))
    return w[pos].sum(axis=1), w[unl].sum(axis=1)


class Model:
    def __init__(self, pos: np.ndarray, unl: np.ndarray, labelled: np.ndarray, y: np.ndarray):
        """Features of trusted positives, unlabelled texts and labelled rows with their labels."""
        self.cuts = self.curve = None
        if not len(pos) or not len(unl):
            return
        self.cuts = Cuts(unl)
        p, u = self.cuts.cells(pos), self.cuts.cells(unl)
        n = int(self.cuts.start[-1])
        self.prior = estimate_prior(*fit_logistic_prior(p, u, n))
        self.w = fit_nnpu(p, u, n, self.prior)
        if 0 < y.sum() < len(y):
            self.curve = logistic(self.margin(labelled)[:, None], y, np.ones(len(y)), ridge=1e-3)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.w[self.cuts.cells(x)].sum(axis=1) + self.w[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.cuts is None:
            return np.zeros(len(x))
        z = self.margin(x)
        return sigmoid(z if self.curve is None else z * self.curve[0] + self.curve[1])


def train(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int = SAMPLE) -> Model:
    """docs: (doc_id, t)."""
    spark = docs.sparkSession
    outside = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)
    known = labels.where(F.col(label).isin(0, 1) & outside).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    # three samples of at most `most` ids each
    picked = [
        first_by_hash(known.where("y = 1"), most).select("doc_id", F.lit("positive").alias("kind"), "y"),
        first_by_hash(known, most).select("doc_id", F.lit("labelled").alias("kind"), "y"),
        first_by_hash(docs.where(outside).select("doc_id"), most).select("doc_id", F.lit("unlabelled").alias("kind"), F.lit(0).alias("y")),
    ]
    ids = spark.createDataFrame(pd.concat([p.toPandas() for p in picked]).reset_index(drop=True), "doc_id long, kind string, y int")

    def describe(batches):
        for pdf in batches:
            yield pdf[["doc_id", "kind", "y"]].assign(x=[list(map(float, features(t))) for t in pdf["t"]])

    rows = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "kind", "y", "t").mapInPandas(describe, "doc_id long, kind string, y int, x array<double>")
    # an id may have many rows: one of them, so that the sample stays bounded
    rows = rows.groupBy("doc_id", "kind", "y").agg(F.min("x").alias("x")).toPandas()
    # sorted here: a sort in Spark would send texts to the driver for its boundaries
    rows = rows.assign(tie=rows["x"].map(tuple)).sort_values(["doc_id", "kind", "tie"]).reset_index(drop=True)
    of = lambda kind: np.array(rows.loc[rows["kind"] == kind, "x"].tolist()).reshape(-1, len(FEATURES))
    return Model(of("positive"), of("unlabelled"), of("labelled"), rows.loc[rows["kind"] == "labelled", "y"].to_numpy(np.float64))


def score(df: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    docs = df.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, folds, held_out))

    def run(batches):
        for pdf in batches:
            x = np.array([features(t) for t in pdf["t"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": model.value.score(x)})

    scored = spread(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held_out).mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
