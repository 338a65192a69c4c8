"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a lazily evaluated expression over the text. The cascade estimates every rule's cost and
rejection rate on a bounded sample, orders the rules by rejections per cost, and chains them so that a
text pays for a rule only if all earlier rules let it pass. The order decides cost alone: a document is
kept exactly if no rule rejects it.

Defined results: null text has no words and is rejected for its length; an empty table gives an empty
table; repeated rows and ties get the same verdict each; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, let, spread, words

SYMBOLS = "#*$%&|<>"
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 1000
#: Times that a job of the estimate runs.
REPEATS = 4


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, SPACES, "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    with_word = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    return let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated(ws: Column) -> Column:
    """Words of ws that stand in a three-word window found twice or more."""

    def windows(h):
        n = F.size(h) - 2
        pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.zip_with(pairs, F.slice(h, 3, n), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))

    def places(s):
        """Starts of the windows that equal a neighbour in the sorted windows s."""
        n = F.size(s) - 1
        equal = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))

    def covered(p):
        n = F.size(p) - 1
        steps = F.zip_with(F.slice(p, 1, n), F.slice(p, 2, n), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(n < 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda x, y: x + y))

    numbered = lambda h: F.array_sort(F.transform(windows(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: let(numbered(h), lambda s: let(places(s), covered)))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(count).cast("long")


def n_repeat_words(text: Column) -> Column:
    return let(words(text), repeated)


@dataclass(frozen=True)
class Rule:
    """Rejects a document when reject(measure) is true; measure computes one of the counts from a text."""

    name: str
    measures: tuple[str, ...]
    reject: Callable[..., Column]


MEASURES: dict[str, Callable[[Column], Column]] = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}

BASE = (
    Rule("too_short", ("n_words",), lambda n: n < 50),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
)
EXTRA = (
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 100 * s > 10 * n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (10 * c < 25 * n) | (10 * c > 120 * n)),
    Rule("dup_lines", ("n_words", "n_dup_lines"), lambda n, d: 10 * d > n),
)


def verdict(rule: Rule, text: Column, ready: dict[str, Column] | None = None) -> Column:
    """Whether rule rejects; measures that are in ready aren't computed again."""
    values = [(ready or {}).get(m) for m in rule.measures]
    return rule.reject(*(MEASURES[m](text) if v is None else v for m, v in zip(rule.measures, values, strict=True)))


def estimate(df: DataFrame, rules, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) on sample_rows rows at most, in the order given. A text is cut into words
    once for all rules, so the sample holds its words and a rule costs what it takes besides. Each job runs REPEATS
    times and its shortest time counts, less that of a job which only reads the sample."""
    t = F.col(text).cast("string")
    sample = df.select(t.alias("t"), words(t).alias("w")).limit(sample_rows).cache()
    rows = max(1, sample.count())
    ready = {"n_words": F.size("w").cast("long"), "n_repeat_words": repeated(F.col("w"))}

    def timed(asked: DataFrame) -> tuple[float, int]:
        best, n = float("inf"), 0
        for _ in range(REPEATS):
            began = time.perf_counter()
            n = asked.head()["n"]
            best = min(best, time.perf_counter() - began)
        return best, n

    empty = timed(sample.agg(F.count_if((F.length("t") < 0) | (F.size("w") < 0)).alias("n")))[0]
    found = []
    for rule in rules:
        spent, rejected = timed(sample.agg(F.count_if(verdict(rule, F.col("t"), ready)).alias("n")))
        # below a hundredth of the empty job differences are noise: such rules cost the same
        found.append((rule, max(spent - empty, empty / 100) / rows, rejected / rows))
    sample.unpersist()
    return found


def ordered(df: DataFrame, rules=BASE + EXTRA, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules, most rejections per cost first; rules that reject nothing of the sample come last, cheapest first."""
    return [r for r, cost, share in sorted(estimate(df, rules, text, sample_rows), key=lambda x: (-x[2] / x[1], x[1]))]


def rejected_by(rules, text: Column, ready: dict[str, Column] | None = None) -> Column:
    """Name of the first rule in this order that rejects, else null; later rules aren't evaluated. A text is cut into
    words once for all rules."""

    def chain(known: dict[str, Column]) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(list(rules)):
            out = F.when(verdict(rule, text, known), F.lit(rule.name)).otherwise(out)
        return out

    if ready is not None:
        return chain(ready)
    return let(words(text), lambda w: chain({"n_words": F.size(w).cast("long"), "n_repeat_words": repeated(w)}))


def quality_filter(df: DataFrame, rules=BASE + EXTRA, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects."""
    return spread(df).where(rejected_by(ordered(df, rules, text, sample_rows), F.col(text).cast("string")).isNull())


def quality_report(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df's doc_id with every measure, base_failed and kept."""
    order = ordered(df, BASE + EXTRA, text, sample_rows)
    t = F.col(text).cast("string")
    counts = spread(df.select("doc_id", text)).select(
        "doc_id",
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated(w).alias("r"))).alias("w"),
        *(MEASURES[m](t).alias(m) for m in ("word_chars", "n_symbols", "n_dup_lines")),
    )
    named = counts.select("doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    ready = {m: F.col(m) for m in MEASURES}
    return named.withColumns(
        {
            "base_failed": rejected_by(BASE, t, ready).isNotNull(),
            "kept": rejected_by(order, t, ready).isNull(),
        }
    )


#: DuckDB: the same counts, from the words themselves.
SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 3),
k AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM g),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM k) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
       OR 10 * word_chars < 25 * n_words OR 10 * word_chars > 120 * n_words OR 10 * n_dup_lines > n_words) AS kept
FROM m
"""
