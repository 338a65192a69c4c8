"""Golden values of names, tokens and metrics."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import metrics as M
from millrace.functions import names as N
from millrace.functions import tokens as T


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).head()["v"]


def arr(text):
    return F.array(*map(F.lit, text.split())) if text else F.array().cast("array<string>")


def test_names(value):
    assert value(N.type_descriptor(F.lit("int[][]"))) == "[[I"
    assert value(N.type_descriptor(F.lit("a.b.C$D"))) == "La/b/C$D;"
    assert value(N.split_descriptor(F.lit("I[[La/B;[JZ"))) == ["I", "[[La/B;", "[J", "Z"]
    assert [value(N.simplify_type(F.lit(x))) for x in ("[[I", "[La/b/C;", "a.b.C", "void", "x/Y")] == ["int[][]", "C[]", "C", "void", "Y"]
    assert value(N.strip_package(F.lit("Ljava/lang/String;"))) == "LString;"
    assert value(N.method_key(F.lit("a.B"), F.lit("m"), F.array(F.lit("int"), F.lit("x.Y[]")), F.lit("void"))) == "a/B#m(I[Lx/Y;)V"
    assert value(N.line_range(F.lit("12-15"))) == (12, 15) and value(N.line_range(F.lit("7"))) == (7, 7)
    assert value(N.is_test_method(F.array(F.lit("org.junit.Test")))) and not value(N.is_test_method(F.array(F.lit("org.junit.Test"), F.lit("org.junit.Ignore"))))
    assert value(N.setup_kind(F.array(F.lit("org.junit.Before")))) == "before"
    assert value(N.accepts(arr("La; I"), arr("[I Z"))) and not value(N.accepts(arr("I"), arr("[I Z")))


def test_subtokens(value):
    assert value(T.subtokens(F.lit("foo"))) == ["", "foo", ""]
    assert value(T.subtokens(F.lit("fooBar2"))) == ["", "foo", "bar", "2", ""]


def test_descriptors_in_pieces(value):
    assert value(T.break_descriptors(arr("POP (I[La/B;)V [La/B; name"))) == ["POP", "(", "I", "[", "L", "a/B", ";", ")", "V", "[", "L", "a/B", ";", "name"]


def test_descriptors_are_recovered(spark):
    for toks in ("POP (I[La/B;)V [La/B; name", "()V x", "I [ [I", "(", "L a", "([J)[[I ) V"):
        whole = toks.split()
        df = spark.createDataFrame([(whole,)], "t array<string>")
        assert df.select(T.recover_descriptors(T.break_descriptors(F.col("t"))).alias("t")).head().t == (["I", "[[I"] if toks == "I [ [I" else whole)


def test_inputs(value):
    got = [tuple(x) for x in value(T.with_inputs([("a", arr("x y")), ("b", arr("z"))], "</s>", names=True))]
    assert got == [("a", None, "a"), ("x", "a", None), ("y", "a", None), ("</s>", None, "b"), ("b", None, "b"), ("z", "b", None)]


def test_instruction_groups(value):
    toks = arr("LDC String POP LDC_END GETFIELD A POP I RETURN")
    got = value(T.group_by_ops(toks, arr("LDC POP GETFIELD RETURN")))
    assert got == [["LDC", "String", "POP", "LDC_END"], ["GETFIELD", "A", "POP", "I"], ["RETURN"]]
    assert value(T.reverse_insns(T.group_by_ops(toks, arr("LDC POP GETFIELD RETURN")))) == ["RETURN", "GETFIELD", "A", "POP", "I", "LDC", "String", "POP", "LDC_END"]


def test_sequences(value):
    assert value(T.pad(arr("a b c"), 5, F.lit("_"))) == ["a", "b", "c", "_", "_"]
    assert value(T.pad(arr("a b c"), 2, F.lit("_"), "left", "left")) == ["b", "c"]
    assert value(T.roll_left(arr("a b c"), F.lit("_"))) == ["b", "c", "_"]
    assert value(T.padded_ngrams(arr("a b"), 2, "<", ">", " ")) == ["< a", "a b", "b >"]
    assert value(T.ngrams(arr("a"), 2)) == []
    assert value(T.cut_at(arr("a b ;x c"))) == ["a", "b", ";"] and value(T.cut_at(arr("a b"))) == ["a", "b"]
    assert value(T.until(arr("a b </s> c"), arr("</s> <pad>"))) == ["a", "b"]
    parts = F.array(arr("f oo"), arr("bar"))
    assert [tuple(x) for x in value(T.offsets(parts))] == [(0, 2), (2, 3)] and value(T.token_of_subtoken(parts)) == [0, 0, 1]
    assert [tuple(x) for x in value(T.shifted(F.array(T.offsets(parts), T.offsets(F.array(arr("x"))))))] == [(0, 2), (2, 3), (3, 4)]
    for n in (0, 1, 127, 128, 129, 257, 5000):
        sizes = [k * 7 % 5 for k in range(n)]
        ends = [sum(sizes[: k + 1]) for k in range(n)]
        many = F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda k: F.array_repeat(F.lit("x"), k))
        assert [tuple(x) for x in value(T.offsets(many))] == [(e - k, e) for k, e in zip(sizes, ends, strict=True)]
    assert value(T.from_subtokens(arr("a b"))) == ["ab"]
    assert value(T.remove_comments(F.lit('a; // x\n\n/* b\n */ s = "//";\n'))).split("\n") == ["a;  ", '  s = "//";']
    assert value(T.normalize_assertion(F.lit("org . junit . Assert . assertEquals ( true , x )"))) == "assertTrue ( x )"
    assert value(T.carried_flags(arr("A x B y"), arr("A B"), arr("B"), 2.0, 1.0)) == [1.0, 1.0, 2.0, 2.0]
    assert tuple(value(T.log_line(F.lit("x int a b c")))) == ("x", "int", "a b c")


HYP1 = "It is a guide to action which ensures that the military always obeys the commands of the party"
REF1 = ["It is a guide to action that ensures that the military will forever heed Party commands", "It is the guiding principle which guarantees the military forces always being under the command of the Party", "It is the practical guide for the army always to heed the directions of the party"]
HYP2 = "It is to insure the troops forever hearing the activity guidebook that party direct"


def clipped_of(value, hyp, refs, n):
    """Clipped precision against several references: the most of them counts."""
    best = {}
    ws = hyp.split()
    grams = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
    for g in set(grams):
        best[g] = min(grams.count(g), max(sum(tuple(r.split()[i : i + n]) == g for i in range(len(r.split()) - n + 1)) for r in refs))
    return sum(best.values()) / max(1, len(grams))


def test_clipped_precision(value):
    for ref in REF1:
        for n in (1, 2):
            a, b = M.precision_parts(arr(ref), arr(HYP1), n)
            assert value(a / b) == pytest.approx(clipped_of(value, HYP1, [ref], n))
    assert value(M.precision_parts(arr("the cat is on the mat"), arr("the the the the the the the"), 1)[0]) == 2


def test_brevity_penalty(value):
    assert value(M.closest_length(F.array(F.lit(11), F.lit(8)), F.lit(7))) == 8
    assert value(M.brevity_penalty(F.lit(8), F.lit(7))) == pytest.approx(0.8668, abs=1e-4)


def test_smoothing(value):
    ref, hyp = "It is a guide to action that ensures that the military will forever heed Party commands", "It is a guide to action which ensures that the military always obeys the commands of the party"
    parts = [M.precision_parts(arr(ref), arr(hyp), n) for n in range(1, 5)]
    lengths = F.size(arr(ref)), F.size(arr(hyp))
    five = M.precision_parts(arr(ref), arr(hyp), 5)
    got = [value(M.combine(M.smooth(parts, m, lengths[1], five[0] / five[1]), [0.25] * 4, M.brevity_penalty(*lengths))) for m in range(8)]
    want = [0.4118, 0.4118, 0.4489, 0.4118, 0.4118, 0.4905, 0.4135, 0.4905]
    # documented to four digits, not rounded
    assert got == pytest.approx(want, abs=1.1e-4)


def test_bleu_edges(value):
    assert value(M.bleu(arr(""), arr("a"))) == 0 and value(M.bleu(arr("a b"), arr("c d"))) == 0
    assert value(M.bleu(arr("a b c d e"), arr("a b c d e"))) == pytest.approx(100)
    assert value(M.bleu(arr("a b"), arr("a b"))) == pytest.approx(100)


def test_other_metrics(spark, value):
    assert value(M.exact_match(arr(""), arr(""))) == 0 and value(M.exact_match_topk(arr(""), arr(""))) == 100
    assert value(M.token_accuracy(arr("a b c"), arr("a x c d"))) == pytest.approx(200 / 3)
    assert value(M.token_accuracy(arr("a b"), arr("a x"), ["a"])) == 0
    assert value(M.weighted_ngram(arr("int x = 1"), arr("int x = 1"))) == pytest.approx(100)
    assert value(M.code_bleu([F.lit(50.0), F.lit(float("nan")), F.lit(None).cast("double"), F.lit(100.0)])) == 75
    assert M.edit_ratio("abcd", "abed") == 75 and M.edit_ratio("", "a") == 0 and M.edit_ratio("same", "same") == 100
    assert M.lcs_length("abcbdab", "bdcaba") == 4
    df = spark.createDataFrame([("a b c . d", "a b c . d"), ("x", "y"), (None, "a")], "g string, p string")
    got = df.select(M.rouge_l("g", "p").alias("r"), M.edit_similarity("g", "p").alias("e")).collect()
    assert got[0].r.f == pytest.approx(100) and got[1].r.f == 0 and got[2].e == 0
    assert value(M.pass_at_k(F.lit(10), F.lit(3), 2)) == pytest.approx(1 - (7 / 10) * (6 / 9))
    assert value(M.pass_at_k(F.lit(1), F.lit(1), 3)) == 1
    s = M.top_k_summary(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(1.0), F.lit(3.0)))
    assert [value(s[k]) for k in ("", "-max", "-min", "-avg", "-wavg")] == [1, 3, 1, 2, 2.5]


def test_syntax_and_data_flow(spark):
    code = "int x = f(a, b + 1); y = x; if (y > 0) { return y; }"
    assert C.syntax_parts(code, code)[0] == C.syntax_parts(code, code)[1] > 5
    renamed = "int p = g(q, r + 2); s = p; if (s > 9) { return s; }"
    assert C.syntax_parts(code, renamed) == C.syntax_parts(code, code)
    assert C.data_flow(code) == C.data_flow(renamed) and ("var_3", "computedFrom", ("var_2",)) not in C.data_flow("")
    assert [e[1] for e in C.data_flow("x = 1; y = x + x; z += y;")] == ["computedFrom", "comesFrom", "comesFrom", "computedFrom", "comesFrom", "computedFrom"]
    other = "while (true) ;"
    assert C.syntax_parts(code, other)[0] < C.syntax_parts(code, code)[1] and C.data_flow_parts(code, other)[0] == 0
    assert C.parsed("f((a]) {").kind == "program" and C.syntax_parts("", "x") == (0, 0)
    df = spark.createDataFrame([(code, renamed), ("", "x"), (None, None)], "g string, p string")
    got = df.select(C.score(C.syntax_match("g", "p")).alias("s"), C.score(C.data_flow_match("g", "p")).alias("d")).collect()
    assert got[0].s == 100 and got[0].d == 100 and got[1].s != got[1].s and got[2].d != got[2].d
