"""URL verdicts by rules, and by trust and distrust that spread over the links between hosts.

A rule names a host, which stands for its subdomains too, and a prefix of the path; the longest rule that fits
decides. Other pages are judged by their host: hosts of pages that a rule allows are trusted seeds, hosts of blocked
ones distrusted seeds, each by its number of such pages. Personalised PageRank carries trust along the links and
distrust against them; a host whose distrust exceeds THRESHOLD times its trust is blocked.

Ranks are whole numbers (FINE in all), every share is rounded down, so that neither the order of summation nor lost
tasks change a result. They are passed on until none changes. The SQL takes ROUNDS rounds over MASS, which comes to the
same where hosts don't link to other hosts, as in the driver's pages. Shares are summed with map-side combining; a host with any share of the links is a skewed join.

Defined results: a url that is null or has no :// has an empty host and path, fits no rule and is allowed; html that
is null has no links; repeated rows count each; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_table, saved


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
MASS = 1_000_000_000_000
#: What settled ranks share out: about the most that whole numbers of 64 bits can hold.
FINE = 10**18
#: Percent of the rank that is passed on along links.
DAMPING = 85
ROUNDS = 8
THRESHOLD = 1
#: Host of a link to another site.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def lowered(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lowered(host), path


def fitting(rules, host: Column, path: Column) -> Column:
    """Text of the longest rule that fits, else null."""
    chain = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        chain = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text)).otherwise(chain)
    return chain


def verdict_of(rules, rule: Column) -> Column:
    chain = F.lit(None).cast("string")
    for r in rules:
        chain = F.when(rule == r.text, F.lit(r.verdict)).otherwise(chain)
    return chain


def seeds(judged: DataFrame, mass: int = MASS) -> DataFrame:
    """(host, kind, seed) from (host, given): trust is spread over allowed hosts, distrust over blocked ones."""
    n = judged.where("given is not null and host != ''").groupBy("host", F.when(F.col("given") == "allow", F.lit("trust")).otherwise(F.lit("distrust")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("kind").agg(F.sum("n").alias("total"))
    return n.join(total, "kind").select("host", "kind", F.expr(f"cast(cast({mass} as decimal(20,0)) * n div total as bigint)").alias("seed"))


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, kind, w, of) from (host, html): a share w / of of src's rank goes to dst."""
    links = pages.where("host != ''").select(F.col("host").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("b")).select("a", lowered(F.col("b")).alias("b")).where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    # trust goes where links go, distrust where they come from
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("trust").alias("kind"), "w").union(links.select("b", "a", F.lit("distrust"), "w"))
    return both.join(both.groupBy("src", "kind").agg(F.sum("w").alias("of")), ["src", "kind"])


def _kept(seed: DataFrame) -> DataFrame:
    return seed.select("host", "kind", F.expr(f"cast(cast(seed as decimal(20,0)) * {100 - DAMPING} div 100 as bigint)").alias("x"))


def _passed_on(seed: DataFrame, edge: DataFrame, rank: DataFrame) -> DataFrame:
    """(host, kind, rank) after a round."""
    passed = edge.join(rank.select(F.col("host").alias("src"), "kind", "rank"), ["src", "kind"]).select(F.col("dst").alias("host"), "kind", F.expr(f"cast(cast(rank as decimal(20,0)) * {DAMPING} * w div (cast(of as decimal(20,0)) * 100) as bigint)").alias("x"))
    return passed.union(_kept(seed)).groupBy("host", "kind").agg(F.sum("x").alias("rank"))


def spread(seed: DataFrame, edge: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, kind, rank) after so many rounds, or as many as change anything."""
    seed, edge = saved(seed, "seeds"), saved(edge, "host-edges")
    rank, state = seed.select("host", "kind", F.col("seed").alias("rank")), None
    for _ in range(rounds):
        rank = saved(_passed_on(seed, edge, rank), "ranks")
        now = tuple(rank.agg(F.count(F.lit(1)), F.sum(F.xxhash64("host", "kind", "rank").cast("decimal(20,0)"))).head())
        if now == state:
            break
        state = now
    return rank


def settled(seed: DataFrame, edge: DataFrame) -> DataFrame:
    """(host, kind, rank) once no rank changes any more. Ranks start at what seeds keep and never shrink, and all
    together stay below the seeds' sum: so the loop ends, and an equal sum means equal ranks."""
    seed, edge = saved(seed, "seeds"), saved(edge, "host-edges")
    rank, sum_ = saved(_kept(seed).withColumnRenamed("x", "rank").where("rank > 0"), "ranks"), None
    while True:
        now = rank.agg(F.sum(F.col("rank").cast("decimal(38,0)"))).head()[0]
        if now == sum_:
            return rank
        last, sum_ = rank, now
        rank = saved(_passed_on(seed, edge, last).where("rank > 0"), "ranks")
        drop_table(last)


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page."""
    host, path = host_and_path(F.col(url).cast("string"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), F.col(html).cast("string").alias("html"))
    ruled = read.withColumn("rule", fitting(rules, F.col("host"), F.col("path"))).withColumn("given", verdict_of(rules, F.col("rule")))
    rank = settled(seeds(ruled.select("host", "given"), FINE), edges(ruled.select("host", "html")))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0))
    bad = rank.groupBy("host").agg((of("distrust") > THRESHOLD * of("trust")).alias("bad")).where("bad")
    page = ruled.select("page_id", "host", "path", "rule", "given")
    return page.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def _sql() -> str:
    cases = "\n".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(RULES, key=lambda r: (-len(r.text), r.text)))
    given = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in RULES)
    rounds = ",\n".join(
        f"r{k + 1} AS (SELECT host, kind, sum(x)::BIGINT AS rank FROM (SELECT e.dst AS host, e.kind, (r.rank::HUGEINT * {DAMPING} * e.w) // (e.of::HUGEINT * 100) AS x FROM e JOIN r{k} r ON e.src = r.host AND e.kind = r.kind UNION ALL SELECT host, kind, (rank::HUGEINT * {100 - DAMPING}) // 100 FROM r0) GROUP BY host, kind)"
        for k in range(ROUNDS)
    )
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT *, CASE {cases} END AS rule FROM h),
g AS (SELECT *, CASE rule {given} END AS given FROM f),
s AS (SELECT host, CASE given WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n FROM g WHERE given IS NOT NULL AND host <> '' GROUP BY ALL),
r0 AS (SELECT host, kind, ({MASS}::HUGEINT * n // sum(n) OVER (PARTITION BY kind))::BIGINT AS rank FROM s),
l AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS b FROM g WHERE host <> ''),
w AS (SELECT a, b, count(*) AS w FROM l WHERE a <> b GROUP BY a, b),
b AS (SELECT a AS src, b AS dst, 'trust' AS kind, w FROM w UNION ALL SELECT b, a, 'distrust', w FROM w),
e AS (SELECT *, sum(w) OVER (PARTITION BY src, kind) AS of FROM b),
{rounds},
t AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) > {THRESHOLD} * coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS bad FROM r{ROUNDS} GROUP BY host)
SELECT page_id, g.host, path, rule, coalesce(given, CASE WHEN t.bad THEN 'block' ELSE 'allow' END) AS verdict FROM g LEFT JOIN t ON g.host = t.host
"""


SQL = _sql()
