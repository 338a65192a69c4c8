"""The pipelines over tests, put together from operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import metrics
from millrace.functions.base import total
from millrace.functions.names import setup_kind
from millrace.operators import filters, focal, ranking, resolve, retrieval, sampling, summary, windows
from millrace.sources import tables

#: Groups of derived columns: what each makes, and what must be there before.
ENRICHMENTS = {
    "types_local": (["types_local"], []),
    "types_absent": (["types_absent"], ["types_local"]),
    "setup_teardown": (["setup_mids", "teardown_mids"], []),
    "fields_set_notset": (["fields_set", "fields_notset"], ["setup_teardown"]),
    "last_called_method": (["last_called_methods"], []),
    "similar_stmts": (["similar_stmts"], []),
    "runtime": (["runtime_types_values_delta"], []),
}


def enrichment_order(wanted: Sequence[str]) -> list[str]:
    """The groups and all that they need, each after what it needs."""
    out: list[str] = []

    def add(name: str) -> None:
        for n in ENRICHMENTS[name][1]:
            add(n)
        if name not in out:
            out.append(name)

    for name in wanted:
        add(name)
    return out


def _by_step(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): a key's values in the order of its steps."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", F.col(value).alias("v_")))).alias("x_")).select(key, F.transform("x_", lambda r: r["v_"]).alias(name))


def _types_local(tests: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    steps = given["n_steps"].select("id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("step"))
    seen = given["locals"].select("id", F.col("step").alias("from_"), "type").groupBy("id", "type").agg((F.min("from_") + 1).alias("from_"))
    rows = steps.join(seen, "id", "left").groupBy("id", "step").agg(F.array_sort(F.collect_set(F.when(F.col("from_") <= F.col("step"), F.col("type")))).alias("types"))
    return tables.extend(tests, _by_step(rows, "id", "types", "types_local"))


def _types_absent(tests: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    rows = windows.types_absent(given["n_steps"], given["wanted"], given["locals"], given["focal_steps"])
    return tables.extend(tests, _by_step(rows, "id", "absent", "types_absent"))


def _setup_teardown(tests: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    kinds = given["class_methods"].select("cid", "mid", setup_kind(F.col("annotations")).alias("kind")).where("kind is not null")
    of = lambda *names: F.array_sort(F.collect_list(F.when(F.col("kind").isin(*names), F.col("mid"))))
    per = kinds.groupBy("cid").agg(of("before", "before_all").alias("setup_mids"), of("after", "after_all").alias("teardown_mids"))
    return tables.extend(tests, per, "cid")


def _fields(tests: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    rows = windows.set_by_step(given["n_steps"], given["fields_first"], given["fields"], "id", "name")
    both = tables.extend(_by_step(rows, "id", "names_set", "fields_set"), _by_step(rows, "id", "names_notset", "fields_notset"))
    return tables.extend(tests, both)


def _last_called(tests: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    rows = given["called"].withColumn("shown_", F.when(filters.short_enough(F.col("toks")), F.col("toks")))
    last = rows.where("shown_ is not null").groupBy("id", F.col("step")).agg(F.max_by("shown_", "i").alias("v"))
    steps = given["n_steps"].select("id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("step")).join(last, ["id", "step"], "left")
    return tables.extend(tests, _by_step(steps, "id", "v", "last_called_methods"))


def _similar(tests: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    found = retrieval.best(retrieval.scores(given["contexts"], retrieval.index(given["statements"], "doc_id", "toks"), "query_id", "doc_id"))
    rows = given["contexts"].select("id", "step", "query_id").join(found.select("query_id", F.struct("score", "doc_id").alias("v")), "query_id", "left")
    return tables.extend(tests, _by_step(rows, "id", "v", "similar_stmts"))


def _runtime(tests: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    kept = windows.changes(given["observed"], ["id", "name"], ["step"], "value")
    maps = kept.groupBy("id", "step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("v"))
    steps = given["n_steps"].select("id", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("step")).join(maps, ["id", "step"], "left")
    return tables.extend(tests, _by_step(steps, "id", "v", "runtime_types_values_delta"))


_ENRICH = {"types_local": _types_local, "types_absent": _types_absent, "setup_teardown": _setup_teardown, "fields_set_notset": _fields, "last_called_method": _last_called, "similar_stmts": _similar, "runtime": _runtime}


def enrich(tests: DataFrame, wanted: Sequence[str], given: dict[str, DataFrame]) -> DataFrame:
    """tests (id, cid, ...) with the derived columns of the groups wanted and of those that they need.

    given: n_steps (id, n); locals (id, step, type); wanted (id, type); focal_steps (id, step); class_methods (cid, mid,
    annotations); fields (id, name); fields_first (id, name, step); called (id, step, i, toks); contexts (id, step,
    query_id, toks); statements (doc_id, toks); observed (id, step, name, value). Only what the groups use is needed."""
    for name in enrichment_order(wanted):
        tests = _ENRICH[name](tests, given)
    return tests


def process(tests: DataFrame, calls: DataFrame, classes: DataFrame, methods: DataFrame, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(tests that pass with their focal methods, counters of the others by reason).

    tests: the columns of filters.test_rules but focal_mid, and test_class if the rules on the tested class are to apply;
    calls: (id, i, owner, namedesc, op)."""
    resolved = resolve.lookup_methods(resolve.lookup_class(calls, classes), classes, methods).where("mid is not null")
    known = methods.select("mid", F.col("cid").alias("mcid"), "name", "has_code").join(classes.select(F.col("cid").alias("mcid"), "scope"), "mcid")
    used = resolved.select("id", "i", "mid").join(known, "mid").select("id", "i", "mid", F.col("mcid").alias("cid"), "scope", "has_code", (F.col("name").startswith("assert") | F.col("name").startswith("fail")).alias("is_assertion"))
    if named := "test_class" in tests.columns:
        tested = tests.select("id", focal.focal_class_name(F.col("test_class")).alias("owner"))
        own = resolve.lookup_class(tested, classes.where("scope = 'APP'")).select("id", F.col("cid").alias("focal_cid"))
        used = used.join(own, "id", "left")
    found = focal.focal_methods(used, focal_class="focal_cid" if named else None).select("id", F.col("mid").alias("focal_mid"))
    rules = filters.test_rules(limits)
    rows = tests.join(found, "id", "left")
    return filters.kept(rows, rules), filters.counters(rows, rules)


def eval_setup(tests: DataFrame, repos: DataFrame, most: int | None, seed: int = 42, per_project: int | None = None, **options) -> DataFrame:
    """An evaluation set: places of each project's tests, sampled round-robin up to `most` of them (None: no limit), cut
    and with gold."""
    split = sampling.splits(tests, repos)
    chosen = sampling.round_robin(sampling.places(split, carry=["proj_name"], **options), "id", [sampling.seeded(F.concat_ws(":", "id", "stmt_i"), seed)], ["id"], most, "proj_name", per_project)
    return sampling.evaluation_set(split, chosen)


def evaluate_rows(preds: DataFrame, key: str, gold: str = "gold", topk: str = "topk", names: Sequence[str] = ("edit-sim", "rouge-f")) -> DataFrame:
    """(key, rank, a column for each metric) of every ranked prediction, by metrics that run in Python."""
    rows = preds.select(key, F.col(gold).alias("g_"), F.posexplode(topk).alias("rank", "p_"))
    return rows.select(key, "rank", *(metrics.ROW_METRICS[n](F.col("g_"), F.col("p_")).alias(n) for n in names))


def _each(metric, gold: str, topk: str) -> Column:
    return F.transform(topk, lambda p: metric(F.col(gold), p).cast("double"))


def evaluate(preds: DataFrame, gold: str = "gold", topk: str = "topk", names: Sequence[str] = ("xmatch", "tok-acc", "bleu")) -> DataFrame:
    """preds with a map of metrics over ranked token arrays: of the first, largest, smallest and mean."""
    pairs: list[Column] = []
    for name in names:
        values = _each(metrics.QUALITY_METRICS[name], gold, topk)
        for suffix, value in metrics.top_k_summary(values).items():
            pairs += [F.lit(name + suffix), value]
        if name == "xmatch":
            for k in (3, 5, 10, 100):
                pairs += [F.lit(f"xmatch-top{k}"), F.array_max(F.slice(values, 1, k))]
    return preds.withColumn("metrics", F.create_map(*pairs))


def rerank_and_summarize(preds: DataFrame, runs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    best = evaluate(ranking.rerank(preds, runs, keys, ["topk"]))
    return best, summary.means(best)


def input_length(parts: Sequence[str]) -> Column:
    return total(F.array(*(F.size(p) for p in parts)), "int")
