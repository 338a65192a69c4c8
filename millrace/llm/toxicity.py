"""Toxicity by nearest labelled examples: exact TF-IDF cosine over the words of a bounded sample of examples.

Terms are all words of the lower-cased texts (runs of letters and digits; each character of a script without spaces is a
word), none is left out. The inverted index keeps frequent words' postings in blocks of BLOCK examples with the block's
largest weight; those of other words are lists. A text's rare words are summed first; with the largest weights of its
frequent ones they bound its cosines with a block. Blocks are scored from the largest bound on, and those whose bound is
below the cosine of the last of the nearest NEIGHBOURS are skipped, so the neighbours are those of comparing all
examples. Words that no example has count in a text's length. Votes are weighted by inverse distance; a logistic curve
fitted on the examples themselves (each without itself) turns the share of votes and the log odds of all words into a
score. The neighbours and their cosines are the evidence.

Labels are learnt from rows outside the held-out fold alone, at most EXAMPLES of each kind. Defined results: null and
empty texts, and texts without a word of an example, have no neighbour and get the score of such examples; labels
without a document, null labels and null doc_ids aren't learnt from; without labels of both kinds every score is 0;
ties between equally near examples go to the smaller example number; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import spread
from millrace.llm.jaccard import fmix
from millrace.llm.samples import first_by_hash, fold
from millrace.llm.suffix_dedup import _pass, words_at

#: Bound of the sample: so many toxic and so many other examples at most.
EXAMPLES = 2000
LENGTHS = (4, 6, 8)
NEIGHBOURS = 10
#: Examples in a block of the index; terms in one of SHARE examples or more are frequent; groups of like examples; texts
#: looked up together. None of them changes a result.
BLOCK = 32
SHARE = 8
GROUPS = 8
AT_ONCE = 64
SCAN = 1 << 16
#: Bytes of texts that are scored together, so that a worker's memory doesn't grow with the batches it gets.
SLICE = 1 << 20
BETWEEN = re.compile(r"[\W_]+")
#: Characters of scripts that are written without spaces.
ALONE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
#: An odd number and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(term, number of its text) of every word in texts. A term is a 64-bit hash of its bytes."""
    raw = []
    for t in texts:
        t = t.lower()
        if not t.isascii():
            t = ALONE.sub(r" \1 ", t)
        raw.append(BETWEEN.sub(" ", t).encode())
    joined = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    space = joined == 32
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power = np.cumprod(np.full(len(joined), BASE, np.uint64))
    back = np.cumprod(np.full(len(joined), INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(joined.astype(np.uint64) * power)])
    code = fmix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(BASE))
    last = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return code, np.searchsorted(last, start, "right")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(term, number of its text) of every place in texts. A term is a 64-bit hash of its bytes and length."""
    raw = [t.lower().encode() for t in texts]
    joined = np.frombuffer((b"\0" * 8).join(raw), np.uint8)
    n = np.fromiter(map(len, raw), np.int64, len(raw)) + 8
    owner = np.repeat(np.arange(len(raw)), n)[: len(joined)]
    u = words_at(joined)[: len(joined)]
    zero = np.concatenate([joined == 0, np.ones(8, bool)])
    bad = zero[: len(joined)].copy()
    codes, owners = [], []
    for k in range(1, max(LENGTHS)):
        bad |= zero[k : k + len(joined)]
        if k + 1 in LENGTHS:
            at = np.flatnonzero(~bad)
            codes.append(fmix((u[at] & np.uint64((1 << 8 * (k + 1)) - 1)) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
            owners.append(owner[at])
    return np.concatenate(codes), np.concatenate(owners)


def counted(texts: list[str], of=words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct terms, counts) of each text."""
    out = []
    for a, b in _pass([t.encode() for t in texts], SCAN):
        code, owner = of(texts[a:b])
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        cut = np.searchsorted(owner[at], np.arange(1, b - a))
        out += list(zip(np.split(code[at], cut), np.split(np.diff(np.append(at, len(code))), cut), strict=True))
    return out


class Vocabulary:
    """Finds the terms among those of texts, which `of` makes."""

    def __init__(self, terms: np.ndarray, of=grams):
        self.terms, self.of = np.sort(terms), of

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, whether it is a term) of each."""
        if not len(self.terms):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.terms, code), len(self.terms) - 1)
        return at, self.terms[at] == code

    def split(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(term numbers, counts, counts of what isn't a term) of each text."""
        out = []
        for code, n in counted(texts, self.of):
            at, ok = self.look_up(code)
            out.append((at[ok], n[ok], n[~ok]))
        return out

    def count(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(term numbers, counts) of each text."""
        return [(t, c) for t, c, _ in self.split(texts)]


NONE = np.empty(0, np.int64)


class Index:
    """Unit TF-IDF vectors of examples. Postings of frequent terms lie in dense blocks with each block's largest weight,
    those of other terms in lists."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_terms: int, ids: np.ndarray | None = None):
        term = np.concatenate([NONE, *(t for t, _ in vectors)]).astype(np.int64)
        df = np.bincount(term, minlength=n_terms)
        self.n_terms, self.n = n_terms, len(vectors)
        self.idf, self.unseen = np.log((1 + self.n) / (1 + df)) + 1, np.log(1 + self.n) + 1
        self.labels, self.ids = np.asarray(labels, np.float64), np.arange(self.n) if ids is None else ids
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.empty(0), *(self.weigh(t, c) for t, c in vectors)])
        frequent = np.flatnonzero((df * SHARE >= self.n) & (df > 0))
        #: Row of a frequent term in the dense blocks, -1 for other terms.
        self.row = np.full(n_terms, -1)
        self.row[frequent] = np.arange(len(frequent))
        row = self.row[term]
        common = row >= 0
        self.n_blocks = -(-self.n // BLOCK)
        self.place = self._places(row[common], example[common], weight[common], len(frequent))
        self.number = np.full(self.n_blocks * BLOCK, -1)
        self.number[self.place] = np.arange(self.n)
        at = self.place[example]
        self.blocks = np.zeros((self.n_blocks, len(frequent), BLOCK))
        self.blocks[at[common] // BLOCK, row[common], at[common] % BLOCK] = weight[common]
        self.block_max = self.blocks.max(axis=2).T if self.n else np.zeros((len(frequent), 0))
        term, at, weight = term[~common], at[~common], weight[~common]
        order = np.lexsort((at, term))
        self.at, self.weight = at[order].astype(np.int32), weight[order]
        self.starts = np.concatenate([NONE, [0], np.cumsum(np.bincount(term, minlength=n_terms))])
        #: In how many toxic and how many other examples each term is.
        every = np.concatenate([NONE, *(t for t, _ in vectors)]).astype(np.int64)
        self.toxic = np.bincount(every, self.labels[example], n_terms)
        self.clean = df - self.toxic

    def _places(self, row: np.ndarray, example: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
        """Places of the examples, so that those alike in their frequent words (of one language), and then of like
        length, stand together: the blocks' bounds differ and are tight, and many blocks are never scored."""
        x = np.zeros((self.n, n_rows))
        x[example, row] = weight
        group = np.zeros(self.n, np.int64)
        if self.n and n_rows:
            x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]
            # the first centre is the mean, each further one the example farthest from all before
            centres, near = [x.mean(axis=0)], np.full(self.n, -1.0)
            for _ in range(GROUPS):
                near = np.maximum(near, x @ centres[-1])
                centres.append(x[near.argmin()])
            for _ in range(8):
                group = (x @ np.array(centres[1:]).T).argmax(axis=1)
                for g in range(GROUPS):
                    if (group == g).any():
                        mean = x[group == g].mean(axis=0)
                        centres[g + 1] = mean / max(1e-12, np.sqrt(mean @ mean))
        length = np.bincount(example, weight, self.n)
        place = np.empty(self.n, np.int64)
        place[np.lexsort((np.arange(self.n), length, group))] = np.arange(self.n)
        return place

    def raw(self, terms: np.ndarray, counts: np.ndarray, others: np.ndarray = NONE) -> tuple[np.ndarray, float]:
        """(weights, length of the whole text's vector)."""
        w, o = (1 + np.log(counts)) * self.idf[terms], (1 + np.log(others)) * self.unseen
        return w, float(np.sqrt((w * w).sum() + (o * o).sum()))

    def weigh(self, terms: np.ndarray, counts: np.ndarray, others: np.ndarray = NONE) -> np.ndarray:
        w, length = self.raw(terms, counts, others)
        return w / length if len(w) else w

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS, without: int = -1, others: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, cosines) of the k nearest examples of cosine above 0, nearest first."""
        return self.nearest_of([(terms, counts, others)], k, [without])[0]

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each text of (terms, counts, others)."""
        out = []
        for a in range(0, len(texts), AT_ONCE):
            some = texts[a : a + AT_ONCE]
            s, _, least = self.scores_of([t for t, _, _ in some], [self.weigh(*x) for x in some], k + (without is not None))
            for i in range(len(some)):
                got = np.flatnonzero((s[i] >= least[i]) & (s[i] > 0))
                number, cos = self.number[got], s[i, got]
                order = np.lexsort((number, -cos))
                if without is not None:
                    order = order[number[order] != without[a + i]]
                out.append((number[order[:k]], cos[order[:k]]))
        return out

    def scores(self, terms: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """scores_of() one text."""
        s, scored, least = self.scores_of([terms], [q], k)
        return s[0], scored[0], float(least[0])

    def scores_of(self, terms: list[np.ndarray], weights: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cosine by place, which blocks were scored, a cosine that the k nearest reach), a row each text. Rare terms
        are summed at once. With the largest weights of the frequent ones they bound the cosines of a block; one whose
        bound is below the k-th best cosine found so far holds none of the k nearest and isn't scored."""
        m, size = len(terms), self.n_blocks * BLOCK
        if not size:
            return np.zeros((m, 0)), np.zeros((m, 0), bool), np.zeros(m)
        text = np.repeat(np.arange(m), [len(t) for t in terms])
        term, q = np.concatenate([NONE, *terms]), np.concatenate([np.empty(0), *weights])
        row = self.row[term]
        common = row >= 0
        asked = np.zeros((m, len(self.block_max)))
        asked[text[common], row[common]] = q[common]
        text, term, q = text[~common], term[~common], q[~common]
        first, n = self.starts[term], self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(n)
        posting = np.arange(n.sum()) + np.repeat(first - (ends - n), n)
        s = np.bincount(np.repeat(text * size, n) + self.at[posting], np.repeat(q, n) * self.weight[posting], m * size).astype(np.float64, copy=False).reshape(m, self.n_blocks, BLOCK)
        bound = asked @ self.block_max + s.max(axis=2)

        def score(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(axis=0)):
                i = np.flatnonzero(chosen[:, b])
                s[i, b] += asked[i] @ self.blocks[b]

        def kth() -> np.ndarray:
            return np.partition(s.reshape(m, -1), size - k, axis=1)[:, size - k] if size > k else np.zeros(m)

        likely = np.zeros((m, self.n_blocks), bool)
        np.put_along_axis(likely, np.argsort(-bound, axis=1, kind="stable")[:, : -(-k // BLOCK) + 1], True, axis=1)
        score(likely)
        more = ~likely & (bound > 0) & (bound * (1 + 1e-9) + 1e-12 >= kth()[:, None])
        score(more)
        # sums in another order differ in the last bits: equal vectors must tie
        np.round(s, 13, out=s)
        return s.reshape(m, -1), likely | more, kth()

    def votes(self, got: np.ndarray, cos: np.ndarray) -> tuple[float, float]:
        """Share of the votes for toxic less a half, and whether there is a neighbour at all. A vote weighs as much as
        the inverse of the neighbour's distance."""
        if not len(got):
            return 0.0, 0.0
        near = 1 / (1.05 - cos)
        return float((near @ self.labels[got]) / near.sum()) - 0.5, 1.0

    def odds(self, terms: np.ndarray, without: int = -1) -> tuple[float, float, float]:
        """Log odds for toxic of all of a text's terms: their sum over the root of their number, and two soft maxima.
        Neighbours are near by all words, so a few insults in a long text hardly move them; they do move these."""
        if not len(terms):
            return 0.0, 0.0, 0.0
        a, b, pos = self.toxic[terms], self.clean[terms], self.labels.sum()
        neg = self.n - pos
        if without >= 0:
            y = self.labels[without]
            a, b, pos, neg = a - y, b - (1 - y), pos - y, neg - (1 - y)
        x = np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1))
        return float(x.sum() / np.sqrt(len(x))), float(np.log(np.exp(x).sum())), float(np.log(np.exp(2 * x).sum()) / 2)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a weighted ridge logistic regression, by Newton steps; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, vocabulary: Vocabulary, index: Index, shares: tuple[float, float]):
        """shares: how many toxic and other labelled rows stand for each example of theirs."""
        self.vocabulary, self.index, self.curve = vocabulary, index, None
        y = index.labels
        if len(y) and 0 < y.sum() < len(y):
            self.weight = np.where(y > 0, shares[1], shares[0])

    def fit(self, vectors) -> Model:
        y = self.index.labels
        if len(y) and 0 < y.sum() < len(y):
            near = self.index.nearest_of([(t, c, NONE) for t, c in vectors], without=np.arange(len(y)))
            x = np.array([self.index.votes(*n) + self.index.odds(t, k) for k, (n, (t, _)) in enumerate(zip(near, vectors, strict=True))])
            self.mean, self.width = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
            self.curve = logistic((x - self.mean) / self.width, y, self.weight)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None or not len(x):
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([(x - self.mean) / self.width, np.ones(len(x))]) @ self.curve, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, examples: int = EXAMPLES) -> Model:
    """docs: (doc_id, t)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = first_by_hash(known.where("y = 1"), examples).union(first_by_hash(known.where("y = 0"), examples))
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "doc_id long, y int")  # 2 * examples rows at most
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "t", "y")

    def words_of(batches):
        for pdf in batches:
            got = counted(pdf["t"].tolist())
            yield pdf[["doc_id", "y"]].assign(terms=[t.tobytes() for t, _ in got], counts=[c.tobytes() for _, c in got])

    # an id may have many rows: one of them, so that the sample stays bounded
    rows = sample.mapInPandas(words_of, "doc_id long, y int, terms binary, counts binary").groupBy("doc_id", "y").agg(F.min(F.struct("terms", "counts")).alias("x"))
    rows = rows.select("doc_id", "y", "x.*").toPandas().sort_values("doc_id").reset_index(drop=True)
    codes, counts = ([np.frombuffer(x, kind) for x in rows[c]] for c, kind in (("terms", np.uint64), ("counts", np.int64)))
    vocabulary = Vocabulary(np.unique(np.concatenate([np.empty(0, np.uint64), *codes])), words)
    vectors = [(vocabulary.look_up(t)[0], c) for t, c in zip(codes, counts, strict=True)]
    index = Index(vectors, rows["y"].to_numpy(), len(vocabulary.terms), rows["doc_id"].to_numpy())
    pos, neg = max(1, (rows["y"] == 1).sum()), max(1, (rows["y"] == 0).sum())
    return Model(vocabulary, index, (n.get(0, 0) / neg, n.get(1, 0) / pos)).fit(vectors)


def score(df: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): evidence has the nearest examples, their cosines and labels."""
    docs = df.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, folds, held_out))

    def run(batches):
        m = model.value
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in _pass([t.encode() for t in texts], SLICE):
                found = m.vocabulary.split(texts[a:b])
                near = m.index.nearest_of(found)
                x = [m.index.votes(*n) + m.index.odds(t) for n, (t, _, _) in zip(near, found, strict=True)]
                evidence = [[{"doc_id": i, "cosine": v, "label": y} for i, v, y in zip(m.index.ids[k].tolist(), cos.tolist(), m.index.labels[k].astype(int).tolist(), strict=True)] for k, cos in near]
                yield pd.DataFrame({"doc_id": pdf["doc_id"][a:b], "held_out": pdf["held_out"][a:b], "score": m.score(np.array(x).reshape(b - a, -1)), "evidence": evidence})

    scored = spread(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held_out).mapInPandas(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
