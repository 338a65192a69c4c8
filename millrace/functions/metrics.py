"""Text-similarity metrics over token arrays, from 0 to 100 unless said otherwise.

Closed formulas are Column expressions; those over longest common subsequences are Arrow UDFs. BLEU's smoothing
method 2 adds one to every order. Edit similarity is the rounded share of matching characters, with substitutions
counted as a deletion and an insertion. ROUGE-L splits at full stops and takes the union of subsequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.base import let, nan, positions, total
from millrace.functions.tokens import ngrams

# Reserved words of Java.
JAVA_KEYWORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split()


def exact_match(gold: Column, pred: Column) -> Column:
    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), 0).when(gold == pred, 100).otherwise(0)


def exact_match_topk(gold: Column, pred: Column) -> Column:
    """Two empty sequences match."""
    return F.when(gold == pred, 100).otherwise(0)


def token_accuracy(gold: Column, pred: Column, ignored: list[str] | None = None) -> Column:
    """Equal tokens at equal places up to the shorter length."""
    n = F.least(F.size(gold), F.size(pred))
    pairs = F.arrays_zip(F.slice(gold, 1, n).alias("g"), F.slice(pred, 1, n).alias("p"))
    if ignored:
        pairs = F.filter(pairs, lambda x: ~x["g"].isin(*ignored))
    return let(pairs, lambda z: F.when(F.size(z) == 0, 0.0).otherwise(100.0 * F.size(F.filter(z, lambda x: x["g"] == x["p"])) / F.size(z)))


def occurrences(grams: Column) -> Column:
    """(gram, how often) for each distinct gram: sorted grams, counted by the places where they change."""

    def cut(s):
        ends = F.filter(positions(F.size(s)), lambda i: (i == F.size(s)) | ~(F.get(s, i - 1) == F.get(s, i)))
        return let(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(s, i - 1).alias("g"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("c"))))

    return let(F.array_sort(grams), cut)


def numbered(grams: Column) -> Column:
    """Each gram with the number of its occurrence: equal elements of two arrays are common elements of multisets."""
    return F.flatten(F.transform(occurrences(grams), lambda x: F.transform(positions(x["c"]), lambda k: F.concat_ws("\u0002", x["g"], k))))


def clipped(reference: Column, hypothesis: Column) -> Column:
    """Size of the common part of two multisets of strings."""

    return F.size(F.array_intersect(numbered(reference), numbered(hypothesis)))


def precision_parts(gold: Column, pred: Column, n: int) -> tuple[Column, Column]:
    """(clipped matches, n-grams of pred, at least 1)."""
    return clipped(ngrams(gold, n), ngrams(pred, n)), F.greatest(F.size(pred) - (n - 1), F.lit(1))


def brevity_penalty(reference_length: Column, hypothesis_length: Column) -> Column:
    ratio = reference_length.cast("double") / F.when(hypothesis_length > 0, hypothesis_length).otherwise(1)
    return F.when(hypothesis_length > reference_length, 1.0).when(hypothesis_length == 0, 0.0).otherwise(F.exp(1 - ratio))


def closest_length(lengths: Column, n: Column) -> Column:
    """The reference length nearest to n, the smaller of two equally near."""
    return F.array_min(F.transform(lengths, lambda x: F.struct(F.abs(x - n).alias("d"), x.alias("x"))))["x"]


def smooth(parts: list[tuple[Column, Column]], method: int, hypothesis_length: Column, extra: Column | None = None, epsilon: float = 0.1, alpha: float = 5.0, k: float = 5.0) -> list[Column]:
    """Precisions of each order from (matches, total), smoothed by methods 0 to 7 of Chen and Cherry. Methods 5 and 7
    take the precision of one order more as extra."""
    raw = [a / b for a, b in parts]
    tiny = F.lit(2.2250738585072014e-308)
    if method == 0:
        return [F.when(a != 0, p).otherwise(tiny) for (a, _), p in zip(parts, raw, strict=True)]
    if method == 1:
        return [F.when(a != 0, p).otherwise(F.lit(epsilon) / b) for (a, b), p in zip(parts, raw, strict=True)]
    if method == 2:
        return [(a + 1) / (b + 1) for a, b in parts]
    if method == 3:
        out, zeros = [], F.lit(0)
        for (a, b), p in zip(parts, raw, strict=True):
            zeros = zeros + F.when(a == 0, 1).otherwise(0)
            out.append(F.when(a == 0, 1 / (F.pow(F.lit(2.0), zeros) * b)).otherwise(p))
        return out
    if method == 4:
        count = F.lit(k) / F.log(F.greatest(hypothesis_length, F.lit(2)).cast("double"))
        return [F.when((a == 0) & (hypothesis_length > 1), (i + count) / b).otherwise(p) for i, ((a, b), p) in enumerate(zip(parts, raw, strict=True))]
    if method == 5:
        return _neighbours(raw, extra)
    if method == 6:
        out = list(raw[:2])
        for i in range(2, len(raw)):
            one, two = out[i - 1], out[i - 2]
            guess = F.when(two == 0, 0.0).otherwise(one * one / F.when(two == 0, 1.0).otherwise(two))
            out.append((parts[i][0] + F.lit(alpha) * guess) / (parts[i][1] + F.lit(alpha)))
        return out
    if method == 7:
        return _neighbours(smooth(parts, 4, hypothesis_length, extra, epsilon, alpha, k), extra)
    raise ValueError(f"no smoothing method {method}")


def _neighbours(precisions: list[Column], extra: Column | None) -> list[Column]:
    """Means of each precision with the smoothed one before it and the plain one after it."""
    after = [*precisions[1:], precisions[-1] if extra is None else extra]
    out, last = [], precisions[0] + 1
    for p, q in zip(precisions, after, strict=True):
        last = (last + p + q) / 3
        out.append(last)
    return out


def combine(precisions: list[Column], weights: list[float], penalty: Column) -> Column:
    return penalty * F.exp(sum(F.lit(w) * F.log(p) for w, p in zip(weights, precisions, strict=True)))


def _bleu(parts, gold_length, pred_length, method, weights, reweigh):
    n = len(weights)
    score = combine(smooth(parts, method, pred_length), weights, brevity_penalty(gold_length, pred_length))
    if reweigh:
        for k in range(n - 1, 0, -1):
            short = combine(smooth(parts[:k], method, pred_length), [1 / k] * k, brevity_penalty(gold_length, pred_length))
            score = F.when(pred_length == k, short).otherwise(score)
    return F.when(parts[0][0] == 0, 0.0).otherwise(score)


def bleu(gold: Column, pred: Column, method: int = 2, orders: int = 4, reweigh: bool = True) -> Column:
    """Sentence BLEU of one reference; 0 if either side is empty."""
    counted = F.struct(*(f.alias(f"{x}{n}") for n in range(1, orders + 1) for x, f in zip("ab", precision_parts(gold, pred, n), strict=True)))
    score = let(counted, lambda c: _bleu([(c[f"a{n}"], c[f"b{n}"]) for n in range(1, orders + 1)], F.size(gold), F.size(pred), method, [1 / orders] * orders, reweigh))
    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), 0.0).otherwise(100 * score)


def corpus_bleu_parts(gold: Column, pred: Column, orders: int = 4) -> list[Column]:
    """Aggregates over rows: matches and totals of each order, lengths."""
    out = []
    for n in range(1, orders + 1):
        a, b = precision_parts(gold, pred, n)
        out += [F.sum(a).alias(f"a{n}"), F.sum(b).alias(f"b{n}")]
    return [*out, F.sum(F.size(gold)).alias("gold_length"), F.sum(F.size(pred)).alias("pred_length")]


def corpus_bleu(orders: int = 4, method: int = 1) -> Column:
    """From the columns of corpus_bleu_parts."""
    parts = [(F.col(f"a{n}"), F.col(f"b{n}")) for n in range(1, orders + 1)]
    return 100 * _bleu(parts, F.col("gold_length"), F.col("pred_length"), method, [1 / orders] * orders, False)


def recall_parts(gold: Column, pred: Column, n: int, keywords: list[str] | None = None) -> tuple[Column, Column]:
    """(clipped matches, n-grams of gold); unigrams weigh 1 if keywords, else a fifth."""
    a, b = ngrams(gold, n), ngrams(pred, n)
    if n > 1 or keywords is None:
        return clipped(a, b).cast("double"), F.greatest(F.size(gold) - (n - 1), F.lit(1)).cast("double")
    weight = lambda g: F.when(g.isin(*keywords), 1.0).otherwise(0.2)
    common = F.transform(F.array_intersect(numbered(a), numbered(b)), lambda x: weight(F.split_part(x, F.lit("\u0002"), F.lit(1))))
    all_ = total(F.transform(a, weight))
    return total(common), F.when(all_ > 0, all_).otherwise(1.0)


def weighted_ngram(gold: Column, pred: Column, keywords: list[str] | None = None, orders: int = 4, legacy: bool = False) -> Column:
    """Weighted n-gram recall, smoothing method 1. legacy: the reference length counts as 2."""
    words = JAVA_KEYWORDS if keywords is None else keywords
    counted = F.struct(*(f.alias(f"{x}{n}") for n in range(1, orders + 1) for x, f in zip("ab", recall_parts(gold, pred, n, words), strict=True)))
    length = F.lit(2) if legacy else F.size(gold)
    score = let(counted, lambda c: _bleu([(c[f"a{n}"], c[f"b{n}"]) for n in range(1, orders + 1)], length, F.size(pred), 1, [1 / orders] * orders, False))
    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), 0.0).otherwise(100 * score)


def code_bleu(parts: list[Column], weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """Weighted mean of the parts that are numbers; parts that are null or NaN don't count."""
    known = [p.isNotNull() & ~F.isnan(p.cast("double")) for p in parts]
    up = sum((F.when(k, w * p).otherwise(0.0) for k, p, w in zip(known, parts, weights, strict=True)), F.lit(0.0))
    down = sum((F.when(k, F.lit(w)).otherwise(0.0) for k, w in zip(known, weights, strict=True)), F.lit(0.0))
    return F.when(down > 0, up / down).otherwise(nan())


def edit_distance_similarity(gold: Column, pred: Column) -> Column:
    """100 (1 - Levenshtein / longer length), over joined tokens."""
    g, p = F.array_join(gold, " "), F.array_join(pred, " ")
    n = F.greatest(F.length(g), F.length(p))
    return F.when(n == 0, 0.0).otherwise(100.0 * (1 - F.levenshtein(g, p) / n))


def lcs_length(a, b) -> int:
    """Length of a longest common subsequence, by bit-parallel rows."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for x in b:
        match = places.get(x, 0) & row
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def edit_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return float(round(200 * lcs_length(a, b) / n)) if a and b else 0.0


def _lcs_members(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence."""
    # what isn't in a matches nothing, and the way back steps over it
    known = set(a)
    b = [x for x in b if x in known]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    out, i, j = set(), n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif best[i - 1][j] > best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def rouge_l_scores(gold: str, pred: str, beta: float = 1.2) -> tuple[float, float, float]:
    """(precision, recall, f), the latter with weight beta on recall."""
    g, p = ([s.split() for s in x.split(".") if s.split()] for x in (gold, pred))
    m, n = len({w for s in g for w in s}), len({w for s in p for w in s})
    if not m or not n:
        return 0.0, 0.0, 0.0
    found: set[str] = set()
    for s in g:
        for t in p:
            found |= {s[k] for k in _lcs_members(s, t)}
    r, q = len(found) / m, len(found) / n
    b = q / (r + 1e-12) if beta is None else beta
    f = (1 + b * b) * r * q / (r + b * b * q + 1e-12)
    return 100 * q, 100 * r, 100 * f


@F.pandas_udf(T.DoubleType())
def edit_similarity(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """Over two columns of strings."""
    return pd.Series([edit_ratio(a or "", b or "") for a, b in zip(gold, pred, strict=True)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in "prf"]))
def rouge_l(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Over two columns of strings."""
    for gold, pred in pairs:
        yield pd.DataFrame([rouge_l_scores(a or "", b or "") for a, b in zip(gold, pred, strict=True)], columns=["p", "r", "f"])


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of k picks out of n is one of c; as independent picks where n or n - c is below k."""
    share = F.when(n > 0, c / n).otherwise(0.0)
    few = 1 - F.pow(1 - share, F.lit(k))
    exact = 1 - F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - F.lit(float(k)) / i))
    return F.when((n < k) | (n - c < k), few).when(c == 0, 0.0).otherwise(exact)


def top_k_accuracy(rank: Column, k: int) -> Column:
    """Aggregate: share of rows whose first match has a rank from 1 to k."""
    return F.avg(F.when(rank.between(1, k), 1.0).otherwise(0.0))


def corpus_recall_parts(gold: Column, pred: Column, keywords: list[str] | None = None, orders: int = 4) -> list[Column]:
    """Aggregates over rows: weighted matches and totals of each order, lengths."""
    words = JAVA_KEYWORDS if keywords is None else keywords
    out = []
    for n in range(1, orders + 1):
        a, b = recall_parts(gold, pred, n, words)
        out += [F.sum(a).alias(f"a{n}"), F.sum(b).alias(f"b{n}")]
    return [*out, F.sum(F.size(gold)).alias("gold_length"), F.sum(F.size(pred)).alias("pred_length")]


def corpus_weighted_ngram(orders: int = 4) -> Column:
    """Weighted n-gram recall of a corpus, from the columns of corpus_recall_parts."""
    return corpus_bleu(orders)


def bleu_of_many(golds: Column, pred: Column, orders: int = 4) -> Column:
    """Sentence BLEU of several references, smoothing method 2, reweighed: a gram counts as often as in the reference
    that has it most often."""

    def most(n: int) -> Column:
        grams = F.transform(golds, lambda g: numbered(ngrams(g, n)))
        return F.size(F.array_intersect(numbered(ngrams(pred, n)), F.array_distinct(F.flatten(grams))))

    counted = F.struct(*(x.alias(k) for n in range(1, orders + 1) for k, x in ((f"a{n}", most(n)), (f"b{n}", F.greatest(F.size(pred) - (n - 1), F.lit(1))))))
    length = closest_length(F.transform(golds, F.size), F.size(pred))
    score = let(counted, lambda c: _bleu([(c[f"a{n}"], c[f"b{n}"]) for n in range(1, orders + 1)], length, F.size(pred), 2, [1 / orders] * orders, True))
    return F.when((F.size(golds) == 0) | (F.size(pred) == 0), 0.0).otherwise(100 * score)


def self_bleu(samples: Column) -> Column:
    """Mean BLEU of each of some token arrays against the others; 100 if there are none."""
    others = lambda i: F.concat(F.slice(samples, F.lit(1), i), F.slice(samples, i + 2, F.greatest(F.size(samples) - i - 1, F.lit(0))))
    scores = F.transform(samples, lambda x, i: bleu_of_many(others(i), x))
    return F.when(F.size(samples) == 0, 100.0).otherwise(total(scores) / F.size(samples))


def _joined(metric):
    """A metric of two texts, for two token arrays."""
    return lambda gold, pred: metric(F.array_join(gold, " "), F.array_join(pred, " "))


#: Metrics that run in Python: of one prediction a row, not inside of expressions over arrays.
ROW_METRICS = {"edit-sim": _joined(edit_similarity), "rouge-f": _joined(lambda g, p: rouge_l(g, p)["f"]), "rouge-p": _joined(lambda g, p: rouge_l(g, p)["p"]), "rouge-r": _joined(lambda g, p: rouge_l(g, p)["r"])}
QUALITY_METRICS = {"xmatch": exact_match, "tok-acc": token_accuracy, "bleu": bleu, "weighted-ngram": weighted_ngram, "levenshtein-sim": edit_distance_similarity}


def top_k_summary(values: Column, weights: Column | None = None) -> dict[str, Column]:
    """Of a metric over ranked predictions: first, largest, smallest, mean and weighted mean."""
    n = F.size(values)
    out = {"": F.get(values, 0), "-max": F.array_max(values), "-min": F.array_min(values), "-avg": F.when(n > 0, total(values) / n)}
    if weights is not None:
        out["-wavg"] = total(F.zip_with(values, weights, lambda x, w: x * w)) / total(weights)
    return out


