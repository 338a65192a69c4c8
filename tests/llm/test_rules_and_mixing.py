import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, quality_rules

WS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x x x x x x", "a b c d\na b c d\n\n \nq", "é ß　ü # * $ | <b>", "ab " * 5000, "l\n" * 60, " ".join(f"word{i}" for i in range(80)), " ".join(f"word{i} |" for i in range(80)), " ".join(f"word{i}" for i in range(80))]


def counted(t):
    t = t or ""
    ws = WS.findall(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WS.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 5 else None, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_words int, kept string")


def test_quality_counts(docs):
    for r in quality_rules.quality_report(docs).collect():
        want = counted(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality_rules.quality_filter(docs).collect()}
    assert kept == {r.doc_id for r in quality_rules.quality_report(docs).where("kept").collect()} == {11, 13}
    assert quality_rules.quality_filter(docs).columns == docs.columns
    assert quality_rules.quality_report(docs.limit(0)).count() == 0


def test_cascade_orders_by_rejections_per_cost(docs):
    rules = quality_rules.BASE + quality_rules.EXTRA
    found = quality_rules.estimate(docs, rules)
    assert [r for r, _, _ in found] == list(rules) and all(c > 0 and 0 <= s <= 1 for _, c, s in found)
    assert set(quality_rules.ordered(docs)) == set(rules)
    names = docs.select(quality_rules.rejected_by(rules, F.col("text")).alias("r")).collect()
    assert names[0].r == "too_short" and names[9].r == "repetitive" and names[12].r == "symbols" and names[13].r is None


def test_no_python_in_plan(docs):
    plan = quality_rules.quality_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing(spark):
    data = [(i, " ".join("w" * (i % 37 + 1)) if i % 11 else (None if i % 2 else ""), "en", ["a", "b", None, "c", "d", "ü"][(i * i) % 6 if i > 400 else 0]) for i in range(2000)]
    data += data[:50]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_report(df).collect()
    assert len(got) == len(data) and sorted(map(str, got)) == sorted(map(str, mixing.mix_report(df.repartition(7)).collect()))
    total = sum(r.size for r in got)
    of = {}
    for r in got:
        of.setdefault((r.source_size, r.target), []).append(r)
    assert abs(sum(t for _, t in of) - total) < 1e-6 * total
    for (size, target), rs in of.items():
        assert sum(r.size for r in rs) == size and target <= 3 * size
        assert all(r.taken <= 3 * r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - target) <= max(40, 0.01 * target)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert mixed.count() == mixing.copies(df, ["doc_id"]).agg(F.sum("copies")).head()[0]


def test_large_documents_do_not_move_a_source_from_its_target(spark):
    r = __import__("random").Random(3)
    data = [(i, "w " * int(r.paretovariate(1.1) * 20), f"s{i % 7}") for i in range(700)]
    got = mixing.mix_report(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for size in {r.source_size for r in got}:
        rs = [r for r in got if r.source_size == size]
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.05 * rs[0].target


def test_mixing_targets_fill_to_the_cap(spark):
    per = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 990), (None, 0)], "s string, source_size long")
    got = {r.s: r.target for r in mixing.targets(per, "s").collect()}
    assert got["a"] == 30 and got[None] == 0
    # 1970 words for b and c, which weigh 2 and 1
    assert abs(got["b"] - 1970 * 2 / 3) < 1e-9 and abs(got["c"] - 1970 / 3) < 1e-9


def test_mixing_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_report(df).count() == 0 and mixing.mixed(df).count() == 0
    only = spark.createDataFrame([(None, None, None), (1, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_report(only).collect()] == [0, 0]


def test_an_expensive_rule_that_rejects_little_comes_last(spark):
    rows = [(k, "word " * (10 if k % 2 else 200) + " ".join(f"w{k}x{i}" for i in range(400 if k % 2 == 0 else 0))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slow = quality_rules.Rule("slow", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 99 * n)
    quick = quality_rules.Rule("quick", ("n_words",), lambda n: n < 50)
    for rules in ([slow, quick], [quick, slow]):
        assert [r.name for r in quality_rules.ordered(df, rules)] == ["quick", "slow"]


def test_repeated_rows_are_judged_alike(spark):
    rows = [(1, "word " * 60), (1, "word " * 60), (None, "a b"), (None, "a b"), (2, None), (2, None)]
    got = quality_rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and len({tuple(r) for r in got}) == 3
