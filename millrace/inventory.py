"""More queries over the driver's tables: one for each operator that the catalog's others don't run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import metrics as M
from millrace.functions import names as N
from millrace.functions import tokens as T
from millrace.functions.base import words
from millrace.operators import filters, focal, ranking, resolve, sampling, summary, trees, tries, visitors, windows
from millrace.plans import stages
from millrace.registry import query
from millrace.sources import exports, tables
from millrace.sources.scratch import shared_dir
from millrace.streaming import changes

_W = r"regexp_extract_all(text, '\p{L}+')"


def _path(t, name: str) -> str:
    return f"{shared_dir(t._spark)}/millrace/{name}-{uuid.uuid4().hex}"


# filters


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 100")
def project_stars(t):
    return t.customer.where(filters.stars_enough(F.col("c_acctbal"), 100)).select("c_custkey")


@query("SELECT c_mktsegment AS status, count(*) AS n, string_agg(c_name, ',' ORDER BY c_name) AS names FROM customer GROUP BY 1")
def project_totals(t):
    return filters.status_totals(t.customer, "c_mktsegment", "c_name").select(F.col("c_mktsegment").alias("status"), "n", F.array_join("names", ",").alias("names"))


@query("SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 <> 0 AS code_module, p_size % 5 < 2 AND p_size % 7 > 0 AS repository FROM part")
def repository_rules(t):
    size = F.col("p_size")
    packaging, path = F.when(size % 2 == 0, "jar").otherwise("pom"), F.when(size % 3 == 0, ".").otherwise("a/b")
    licence = F.element_at(F.array(*map(F.lit, ("mit", "apache", "gpl", "none", ""))), size % 5 + 1)
    ok = filters.repository_ok(licence, ["mit", "apache"], F.lit("maven"), size % 7)
    return t.part.select("p_partkey", filters.is_code_module(packaging, path).alias("code_module"), ok.alias("repository"))


@query("SELECT event_id, epoch(ts) >= 1577836800 AS recent FROM events")
def recent_repositories(t):
    return t.events.select("event_id", filters.recent(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("recent"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN (p_size & 2) = 0 ELSE p_size % 2 = 0 AND (p_size & 5) <> 0 END AS kept FROM part")
def scan_visibility(t):
    scope = F.element_at(F.array(*map(F.lit, ("APP", "LIB", "JRE"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.when(F.col("p_size") % 2 == 0, "java.util.List").otherwise("sun.misc.Unsafe")
    return t.part.select("p_partkey", filters.visible(F.col("p_size"), scope, name).alias("kept"))


_CASCADE = """CASE WHEN i = 1 THEN 'badly_named' WHEN i = 2 THEN 'has_parameters' WHEN i = 3 THEN 'not_void' WHEN i = 4 THEN 'no_code' WHEN i = 5 THEN 'local_class' WHEN i = 6 THEN 'no_focal_method' WHEN i = 7 THEN 'mapping_error'
WHEN n = 0 THEN 'too_few_stmts' WHEN n > 20 THEN 'too_many_stmts' WHEN i = 8 THEN 'focal_too_short' WHEN i = 9 THEN 'focal_too_long' WHEN 12 * n > 398 THEN 'too_long' WHEN i = 10 THEN 'stmt_too_long' WHEN i = 11 THEN 'control_flow' WHEN i = 12 THEN 'invokedynamic' END"""


@query(f"SELECT o_orderkey, {_CASCADE} AS reason FROM (SELECT o_orderkey, o_orderkey % 15 AS i, o_custkey % 23 AS n FROM orders)")
def test_rule_reasons(t):
    i, n = F.col("o_orderkey") % 15, (F.col("o_custkey") % 23).cast("int")
    stmt = F.array_repeat(F.lit("x"), 12)
    stmts = F.when((i == 10) & n.between(1, 20), F.array(F.array_repeat(F.lit("x"), 101))).otherwise(F.array_repeat(stmt, n))
    focal_size = F.when(i == 8, 0).when(i == 9, 201).otherwise(1)
    rows = t.orders.select(
        "o_orderkey",
        F.when(i == 1, "Test_3").otherwise("testAdd").alias("name"),
        F.when(i == 2, F.array(F.lit("int"))).otherwise(F.array().cast("array<string>")).alias("ptypes"),
        F.when(i == 3, "int").otherwise("void").alias("rtype"),
        F.lit(True).alias("has_ast"),
        (i != 4).alias("has_bytecode"),
        F.when(i == 5, F.array(F.lit("LocalClassDeclarationStmt"))).otherwise(F.array(F.lit("ExpressionStmt"))).alias("node_types"),
        F.when(i != 6, F.col("o_custkey")).alias("focal_mid"),
        (i == 7).alias("mapping_error"),
        stmts.alias("test_stmt_toks"),
        F.array(F.lit("m")).alias("test_sign_toks"),
        F.array_repeat(F.lit("f"), focal_size).alias("focalm_toks"),
        (i == 11).alias("has_control_flow"),
        F.array(F.when(i == 12, "INVOKEDYNAMIC").otherwise("POP")).alias("insn_toks"),
    )
    return filters.cascade(rows, filters.test_rules(), "reason").select("o_orderkey", "reason")


@query("SELECT conv_id, turn, role = 'assistant' AS assertion, starts_with(role, 'a') AS name, CASE role WHEN 'user' THEN 'before' WHEN 'system' THEN 'after_all' END AS setup FROM conversations")
def assertions_and_setup(t):
    first = F.when(F.col("role") == "assistant", "assertEquals").otherwise(F.col("role"))
    notes = F.array(F.when(F.col("role") == "user", "org.junit.Before").when(F.col("role") == "system", "org.junit.jupiter.api.AfterAll").otherwise("org.junit.Test"))
    return t.conversations.select("conv_id", "turn", N.is_assertion(F.array(first, F.lit("("))).alias("assertion"), N.is_assertion_name(first).alias("name"), N.setup_kind(notes).alias("setup"))


@query("SELECT p_partkey, p_size % 3 = 1 AS test FROM part")
def test_annotations(t):
    notes = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("org.junit.Test"), F.lit("org.junit.Ignore"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("x.Y"), F.lit("org.junit.jupiter.api.Test"))).otherwise(F.array(F.lit("x.Y")))
    return t.part.select("p_partkey", N.is_test_method(notes).alias("test"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 2) AS valid, c_acctbal >= 1000 AS similar FROM customer")
def runtime_and_similarity_rules(t):
    k = F.col("c_custkey") % 4
    delta = F.when(k == 0, F.array_repeat(F.lit(1), 3)).when(k == 1, F.array_repeat(F.lit(1), 2)).when(k == 2, F.array_repeat(F.lit(2), 3))
    return t.customer.select("c_custkey", filters.runtime_valid(delta, F.array(F.lit("a"), F.lit("b"))).alias("valid"), filters.similar_enough(F.col("c_acctbal"), 1000.0).alias("similar"))


# names and resolution


@query("SELECT c_custkey, c_mktsegment AS simple, 'x.' || c_mktsegment AS tested FROM customer")
def class_names(t):
    simple = N.simple_name(F.concat(F.lit("a.b."), "c_mktsegment"))
    test = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("x."), "c_mktsegment", F.lit("Test"))).otherwise(F.concat(F.lit("x.Test"), "c_mktsegment"))
    return t.customer.select("c_custkey", simple.alias("simple"), focal.focal_class_name(test).alias("tested"))


def _members(t):
    """Classes (k; 2k extends nothing, 2k + 1 extends 2k; 4k + 3 implements interface k) and their methods. Ids of class k
    and its method are 2k, those of interface k and its method 2k + 1, so no number of parts makes them meet."""
    k, i = F.col("p_partkey"), F.floor(F.col("p_partkey") / 4)
    ext = F.when(k % 2 == 1, 2 * (k - 1))
    impl = F.when(k % 4 == 3, F.array(2 * i + 1)).otherwise(F.array().cast("array<long>"))
    own = t.part.select((2 * k).alias("cid"), ext.alias("ext"), impl.alias("impl"), F.concat(F.lit("c"), k).alias("name"), F.lit(1).alias("access"))
    faces = t.part.where("p_partkey % 4 = 3").select((2 * i + 1).alias("cid"), F.lit(None).cast("long").alias("ext"), F.array().cast("array<long>").alias("impl"), F.concat(F.lit("i"), i).alias("name"), F.lit(0x200).alias("access"))
    classes = own.union(faces)
    methods = own.where("cid % 4 = 0").select(F.col("cid").alias("mid"), "cid", F.lit("up()V").alias("namedesc"), F.lit(1).alias("access"))
    methods = methods.union(faces.select(F.col("cid").alias("mid"), "cid", F.lit("side()V").alias("namedesc"), F.lit(0x401).alias("access")))
    return classes, methods


def _shown(id: str, interfaces: int):
    """The number that a class or method of _members is shown by; those of interfaces are counted from `interfaces`."""
    n = F.floor(F.col(id) / 2).cast("long")
    return F.when(F.col(id) % 2 == 0, n).otherwise(n + interfaces)


_OPS = ("INVOKEVIRTUAL", "INVOKEINTERFACE", "INVOKESPECIAL", "INVOKESTATIC")


@query("""WITH q AS (SELECT p_partkey AS cid, op, nd FROM part, (SELECT unnest(['INVOKEVIRTUAL','INVOKEINTERFACE','INVOKESPECIAL','INVOKESTATIC']) AS op) a, (SELECT unnest(['up()V','side()V']) AS nd) b),
f AS (SELECT DISTINCT 1000000 + p_partkey // 4 AS cid, op, nd FROM part, (SELECT unnest(['INVOKEVIRTUAL','INVOKEINTERFACE','INVOKESPECIAL','INVOKESTATIC']) AS op) a, (SELECT unnest(['up()V','side()V']) AS nd) b WHERE p_partkey % 4 = 3)
SELECT cid, nd AS namedesc, op, CASE WHEN op = 'INVOKEINTERFACE' THEN NULL WHEN nd = 'up()V' AND cid % 2 = 0 THEN cid WHEN op = 'INVOKESTATIC' THEN NULL WHEN nd = 'up()V' THEN cid - 1 WHEN cid % 4 = 3 THEN 6000000 + cid // 4 END AS mid FROM q
UNION ALL SELECT cid, nd, op, CASE WHEN nd = 'side()V' AND op <> 'INVOKEVIRTUAL' THEN cid + 5000000 END FROM f""")
def method_lookup_by_op(t):
    classes, methods = _members(t)
    asked = classes.select("cid", F.explode(F.array(*map(F.lit, _OPS))).alias("op")).select("cid", "op", F.explode(F.array(F.lit("up()V"), F.lit("side()V"))).alias("namedesc"))
    return resolve.lookup_methods(asked, classes, methods).select(_shown("cid", 1_000_000).alias("cid"), "namedesc", "op", _shown("mid", 6_000_000).alias("mid"))


@query("SELECT p_partkey + 10 AS src, p_partkey - p_partkey % 2 AS dst FROM part")
def call_edges(t):
    classes, methods = _members(t)
    calls = t.part.select((F.col("p_partkey") + 10).alias("src"), F.concat(F.lit("c"), "p_partkey").alias("owner"), F.lit("up()V").alias("namedesc"), F.lit("INVOKEVIRTUAL").alias("op"))
    lost = calls.select("src", F.lit("nowhere").alias("owner"), "namedesc", "op")
    return resolve.call_edges(calls.union(calls).union(lost), classes, methods).select(F.col("src").cast("long").alias("src"), _shown("dst", 6_000_000).alias("dst"))


@query("SELECT c_name, c_custkey, max(c_custkey) OVER (PARTITION BY c_mktsegment) AS cid FROM customer")
def class_lookup(t):
    classes = t.customer.select(F.col("c_custkey").alias("cid"), F.col("c_mktsegment").alias("name"), F.lit(None).cast("long").alias("ext"))
    owners = t.customer.select("c_name", "c_custkey", F.col("c_mktsegment").alias("owner"))
    return resolve.lookup_class(owners, classes).select("c_name", "c_custkey", F.col("cid").cast("long").alias("cid"))


@query("SELECT c_mktsegment AS name, min(c_custkey) AS cid FROM customer GROUP BY 1")
def classpath_union(t):
    c = t.customer.select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("cid")).groupBy("name").agg(F.min("cid").alias("cid"))
    return tables.classpath([c, c.withColumn("cid", F.lit(-1).cast("long"))])


# trees


def _turns(t) -> DataFrame:
    """(conv_id, turn, w, n): turns of at least one word as trees."""
    w = words(F.col("text"))
    leaf = lambda x: F.concat(F.lit('["StringLiteralExpr:id","2","'), x, F.lit('"]'))
    tree = F.concat(F.lit('["Turn","1-2",["Role:kw","1","'), F.col("role"), F.lit('"],["BlockStmt","2",'), F.array_join(F.transform(w, leaf), ","), F.lit("]]"))
    return t.conversations.where(F.size(w) > 0).select("conv_id", "turn", w.alias("w"), trees.parse_tree(tree).alias("n"))


_TURNS = f"(SELECT conv_id, turn, role, {_W} AS w FROM conversations) WHERE len(w) > 0"


@query(f"SELECT conv_id, turn, role AS sign, role || repeat(' STR', len(w)) AS masked, len(list_distinct(w))::INT AS names, 3::INT AS above FROM {_TURNS}")
def tree_rewrites(t):
    n = F.col("n")
    above = trees.without_subtrees(n, lambda x: x["ast_type"] == "BlockStmt")
    return _turns(t).select(
        "conv_id", "turn", T.joined(trees.tree_tokens(trees.signature(n))).alias("sign"), T.joined(trees.tree_tokens(trees.mask_literals(n))).alias("masked"),
        F.size(trees.referenced(n, "StringLiteralExpr")).alias("names"), F.size(above).alias("above"),
    )


@query(f"SELECT conv_id, turn, 'Turn Role BlockStmt' || repeat(' StringLiteralExpr', len(w)) AS pre, 'Turn Role BlockStmt' || repeat(' StringLiteralExpr', len(w)) AS level, 'Role' || repeat(' StringLiteralExpr', len(w)) || ' BlockStmt Turn' AS post, 'T B' || repeat(' t', len(w)) AS kinds FROM {_TURNS}")
def tree_orders(t):
    kinds = lambda nodes: T.joined(F.transform(nodes, lambda x: x["ast_type"]))
    seen = visitors.visited(F.filter("n", lambda x: x["ast_type"] != "Role"), {"Turn": lambda x: F.lit("T"), "BlockStmt": lambda x: F.lit("B")}, lambda x: F.lit("t"))
    return _turns(t).select("conv_id", "turn", kinds(trees.pre_order(F.col("n"))).alias("pre"), kinds(trees.breadth_first(F.col("n"))).alias("level"), kinds(trees.post_order(F.col("n"))).alias("post"), T.joined(seen).alias("kinds"))


# tokens


@query("SELECT c_custkey, 'PUTFIELD a b LDC x POP LDC_END RETURN' AS toks, 'RETURN LDC x POP LDC_END PUTFIELD a b' AS turned, 3::INT AS n FROM customer")
def instruction_sequences(t):
    toks = F.array(*map(F.lit, "PUTFIELD a b LDC x POP LDC_END RETURN".split()))
    insns = T.group_by_ops(toks, F.array(*map(F.lit, "PUTFIELD LDC POP RETURN".split())))
    return t.customer.select("c_custkey", T.joined(F.flatten(insns)).alias("toks"), T.joined(T.reverse_insns(insns)).alias("turned"), F.size(insns).alias("n"))


@query("SELECT p_partkey, ['assertTrue ( f (x) )','assertFalse ( y )','assertEquals ( a , b )','assertTrue ( x )'][p_partkey % 4 + 1] AS plain FROM part")
def normalized_assertions(t):
    given = ["org . junit . Assert . assertEquals ( true , f (x) ) ;", "assertEquals ( false , y )", "assertEquals ( a , b )", "org . junit . Assert . assertTrue ( x )"]
    return t.part.select("p_partkey", T.normalize_assertion(F.element_at(F.array(*map(F.lit, given)), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("plain"))


@query("SELECT doc_id, 'a ' || lang || ' z' AS filled, trim(substr(text, 1, 3)) = '' AS blank, lang IN ('en', 'de') AS special FROM documents")
def templates_and_specials(t):
    return t.documents.select("doc_id", T.fill(F.lit("a /*TESTSTMT*/ z"), F.col("lang")).alias("filled"), T.is_blank(F.substring("text", 1, 3)).alias("blank"), T.is_special(F.col("lang"), ["en", None, "de"]).alias("special"))


@query("SELECT r_name, 'jar' AS packaging, replace(lower(r_name), ' ', '') AS name, 'a/b c' AS path FROM region")
def module_lines(t):
    line = F.concat(F.lit(" jar  "), F.translate(F.lower("r_name"), " ", ""), F.lit(" a/b c "))
    return t.region.select("r_name", T.module_line(line).alias("m")).select("r_name", "m.*")


@query(f"SELECT conv_id, turn, (len(w) + 1)::INT AS grams, (3 * len(w) + 2)::INT AS last_end FROM (SELECT conv_id, turn, {_W} AS w FROM conversations)")
def padded_grams_and_shifts(t):
    w = words(F.col("text"))
    parts = T.offsets(F.transform(w, lambda x: F.array(x, x, x)))
    both = T.shifted(F.array(parts, T.offsets(F.array(F.array(F.lit("a"), F.lit("b"))))))
    return t.conversations.select("conv_id", "turn", F.size(T.padded_ngrams(w, 2, "<", ">")).alias("grams"), F.element_at(both, -1)["end"].alias("last_end"))


@query(f"SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: reverse(x)), ' ') AS turned, len(w)::INT AS n, array_to_string(list_concat(w[1:3], list_transform(range(0, greatest(3 - len(w), 0)), lambda i: '_')), ' ') || ' _ _ _' AS padded FROM (SELECT conv_id, turn, {_W} AS w FROM conversations)")
def nested_arrays(t):
    w = words(F.col("text"))
    nested = F.array(w)
    turned = T.of_elements(nested, 2, F.reverse)
    sizes = T.of_innermost(nested, 2, F.size)
    padded = T.pad_nested(nested, [2, 3], F.lit("_"))
    return t.conversations.select("conv_id", "turn", T.joined(F.flatten(turned)).alias("turned"), F.get(sizes, 0).alias("n"), T.joined(F.flatten(padded)).alias("padded"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'Map' ELSE 'null' END AS type, 'a=1,k=2' AS items FROM events")
def rendered_values(t):
    name = F.when(F.col("event_id") % 3 == 0, "java.lang.Integer").when(F.col("event_id") % 3 == 1, "java.util.Map")
    items = T.sorted_items(F.create_map(F.lit("k"), F.lit("2"), F.lit("a"), F.lit("1")))
    return t.events.select("event_id", T.shown_type(name).alias("type"), F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("items"))


@query("SELECT doc_id, substr(text, 1, least(5, length(string_split(text, chr(10))[1]))) AS span FROM documents")
def spans_of_code(t):
    first = F.length(F.get(F.split("text", "\n", -1), 0))
    end = F.struct(F.lit(0).alias("line"), F.least(F.lit(5), first).alias("column"))
    return t.documents.select("doc_id", T.span_text(F.col("text"), F.struct(F.lit(0).alias("line"), F.lit(0).alias("column")), end).alias("span"))


@query(f"SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: CASE WHEN lower(x) = 'the' THEN '2.0' ELSE '1.0' END), ' ') AS flags FROM (SELECT conv_id, turn, {_W} AS w FROM conversations)")
def carried_scales(t):
    w = F.transform(words(F.col("text")), F.lower)
    flags = T.carried_flags(w, w, F.array(F.lit("the")), 2.0, 1.0)
    return t.conversations.select("conv_id", "turn", T.joined(flags.cast("array<string>")).alias("flags"))


# samples


@query("SELECT conv_id, stmt_i FROM (SELECT conv_id, unnest(range(0, count(*))) AS stmt_i FROM conversations GROUP BY 1)")
def validation_rows(t):
    per = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("test_stmt_toks"))
    return sampling.validation_rows(per).select("conv_id", F.col("stmt_i").cast("long").alias("stmt_i"))


@query("SELECT conv_id, true AS inside FROM conversations GROUP BY 1")
def training_rows(t):
    per = t.conversations.groupBy("conv_id").agg(F.collect_list("role").alias("test_stmt_toks"))
    return sampling.training_rows(per, key="conv_id").select("conv_id", F.col("stmt_i").between(0, F.size("test_stmt_toks") - 1).alias("inside"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def rows_in_order(t):
    ids = t.orders.select("o_orderkey", F.col("o_orderkey").alias("pos"))
    return tables.read_in_order(t.orders, ids, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 2")
def capped_evaluation(t):
    tests = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("proj_name"), F.array(F.array(F.lit("a"))).alias("test_stmt_toks"))
    repos = t.customer.select(F.col("c_custkey").alias("proj_name"), F.lit("val").alias("sources"))
    per = stages.eval_setup(tests, repos, None, per_project=2)
    return per.select(F.col("proj_name").alias("o_custkey"), F.col("id").alias("o_orderkey"))


# metrics and summaries


@query("""WITH g AS (SELECT item_id, regexp_extract_all(text, '\\p{L}+') AS w FROM benchmark) SELECT round(avg(CASE WHEN len(w) < 1 THEN 0 ELSE 100 END), 6)::DOUBLE AS score FROM g""")
def bleu_of_equal_texts(t):
    w = words(F.col("text"))
    return t.benchmark.select(F.when(F.size(w) > 0, M.bleu_of_many(F.array(w, F.array(F.lit("x"))), w)).otherwise(0.0).alias("b")).agg(F.round(F.avg("b"), 6).alias("score"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 0.0 ELSE 100.0 END::DOUBLE AS score FROM customer")
def self_bleu(t):
    a, b = F.array(*map(F.lit, "a b c d e".split())), F.array(*map(F.lit, "v w x y z".split()))
    none = F.array().cast("array<array<string>>")
    samples = F.when(F.col("c_custkey") % 3 == 0, F.array(a, a, a)).when(F.col("c_custkey") % 3 == 1, F.array(a, b)).otherwise(none)
    return t.customer.select("c_custkey", F.round(M.self_bleu(samples), 9).alias("score"))


_GRAMS = " UNION ALL ".join(f"SELECT item_id, doc_id, {n} AS k, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram, side FROM u" for n in range(1, 5))


@query(f"""WITH n AS (SELECT count(*) AS n FROM benchmark), p AS (SELECT item_id, d.doc_id, regexp_extract_all(b.text, '\\p{{L}}+') AS g, regexp_extract_all(d.text, '\\p{{L}}+') AS p FROM benchmark b, n JOIN documents d ON d.doc_id % n.n = item_id),
u AS (SELECT item_id, doc_id, g AS w, 'g' AS side FROM p UNION ALL SELECT item_id, doc_id, p, 'p' FROM p),
c AS (SELECT item_id, doc_id, k, gram, side, count(*) AS c FROM ({_GRAMS}) GROUP BY ALL),
x AS (SELECT item_id, doc_id, k, gram, c, CASE WHEN k = 1 AND gram NOT IN ('the', 'of') THEN 0.2 ELSE 1.0 END AS w FROM c WHERE side = 'g'),
a AS (SELECT x.k, sum(least(x.c, y.c) * w) AS a FROM x JOIN c y ON y.side = 'p' AND x.item_id = y.item_id AND x.doc_id = y.doc_id AND x.k = y.k AND x.gram = y.gram GROUP BY 1),
t AS (SELECT item_id, doc_id, k.k, greatest(coalesce(sum(c * w), 0), CASE WHEN coalesce(sum(c * w), 0) > 0 THEN 0 ELSE 1 END) AS b FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) k LEFT JOIN x USING (item_id, doc_id, k) GROUP BY ALL),
b AS (SELECT k, sum(b) AS b FROM t GROUP BY 1), l AS (SELECT sum(len(g)) AS lg, sum(len(p)) AS lp FROM p)
SELECT round(100 * CASE WHEN lp > lg THEN 1.0 ELSE exp(1 - lg / lp) END * (SELECT exp(sum(0.25 * ln(CASE WHEN coalesce(a, 0) > 0 THEN a / b ELSE 0.1 / b END))) FROM b LEFT JOIN a USING (k)), 6)::DOUBLE AS score FROM l""")
def weighted_ngram_corpus(t):
    n = t.benchmark.count()
    both = t.benchmark.select("item_id", words(F.col("text")).alias("g")).join(t.documents.select((F.col("doc_id") % n).alias("item_id"), words(F.col("text")).alias("p")), "item_id")
    return both.agg(*M.corpus_recall_parts(F.col("g"), F.col("p"), ["the", "of"])).select(F.round(M.corpus_weighted_ngram(), 6).alias("score"))


@query("SELECT k AS metric, sum(v)::DOUBLE AS total, count(*)::INT AS n FROM (SELECT 'quality' AS k, quality AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY 1")
def metric_merge(t):
    of = lambda *names: summary.collected(t.labels.select(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("double")))).alias("metrics")))
    both = summary.merged_metrics(of("quality", "toxic"), of("toxic"))
    return both.select("metric", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("values").alias("n"))


@query("SELECT p_name, p_brand, other AS found, d::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY d, other) AS r FROM (SELECT DISTINCT a.p_name, a.p_brand, b.p_name AS other, levenshtein(a.p_name, b.p_name) AS d FROM part a JOIN part b ON a.p_brand = b.p_brand)) WHERE r <= 3")
def fuzzy_signatures(t):
    asked = t.part.select("p_brand", "p_name").distinct()
    return summary.nearest_texts(asked, t.part, ["p_brand"], "p_name", 3).select("p_name", "p_brand", "found", "distance")


@query(f"SELECT a.conv_id, a.turn, array_to_string(list_distinct(list_filter(a.w, lambda x: NOT list_contains(b.w, x))), ' ') = '' AS none FROM (SELECT conv_id, turn, {_W} AS w FROM conversations) a JOIN (SELECT conv_id, {_W} AS w FROM conversations WHERE turn = 0) b USING (conv_id)")
def missing_tokens(t):
    first = t.conversations.where("turn = 0").select("conv_id", words(F.col("text")).alias("r"))
    rows = t.conversations.select("conv_id", "turn", words(F.col("text")).alias("w")).join(first, "conv_id")
    return rows.select("conv_id", "turn", (F.size(summary.missing_tokens(F.col("w"), F.col("r"))) == 0).alias("none"))


@query("SELECT doc_id, coalesce(toxic * 100, 0)::INT AS compilable, coalesce(quality * 100, 0)::INT AS runnable FROM documents LEFT JOIN labels USING (doc_id)")
def runtime_metrics(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.when(F.col("toxic").isNotNull(), F.array(F.col("toxic") * 100)).alias("topk_compilable"), F.when(F.col("quality").isNotNull(), F.array(F.col("quality") * 100)).alias("topk_runnable"))
    return ranking.runtime_metrics(rows).select("doc_id", "compilable", "runnable")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events)")
def paired_rows(t):
    gold = t.events.select(F.col("event_id").alias("pos"), "user_id")
    return ranking.paired(gold, t.events.select(F.col("event_id").alias("pos"), "event_id"), "pos").select("user_id", "event_id")


_KEYS = "SELECT page_id, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.') AS k FROM pages"


@query(f"SELECT page_id, array_to_string(k, '.') AS key, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS value FROM ({_KEYS}) WHERE page_id % 5 <> 0")
def trie_changes(t):
    keys = t.pages.select("page_id", F.concat(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\."), F.array(F.col("page_id").cast("string"))).alias("key"))
    old = keys.select("key", F.struct("page_id", F.lit("old").alias("v")).alias("value"))
    new = tries.updated(old, keys.where("page_id % 3 = 0").select("key", F.struct("page_id", F.lit("new").alias("v")).alias("value")))
    left = tries.removed(new, keys.where("page_id % 5 = 0"))
    return left.select("value.page_id", F.array_join(F.slice("key", F.lit(1), F.size("key") - 1), ".").alias("key"), F.col("value.v").alias("value"))


@query("SELECT c_custkey FROM customer WHERE regexp_full_match(c_mktsegment, '[BUILDNGFRTE]+')")
def trie_within_set(t):
    keys = t.customer.select(F.split("c_mktsegment", "").alias("key"), F.col("c_custkey").alias("value"))
    return tries.within_set(keys, F.array(*map(F.lit, "BUILDNGFRTE"))).select(F.col("value").alias("c_custkey"))


# sources and sinks: what is written is read again


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders")
def columns_written(t):
    path = _path(t, "columns")
    tables.write_columns(t.orders, path, only=["o_orderkey", "o_custkey"])
    tables.write_columns(t.orders, path, append=True, only=["o_orderkey", "o_custkey"])
    return tables.read_columns(t._spark, path, exclude=["o_orderstatus"])


@query("SELECT doc_id AS pos, 'd' || doc_id AS id, lang FROM documents")
def column_files_read(t):
    path = _path(t, "fields")
    for name, value in (("id", F.concat(F.lit("d"), "doc_id")), ("lang", F.col("lang"))):
        # one file a field, whose lines stand in order
        lines = t.documents.select("doc_id", F.concat(F.lit('"'), value, F.lit('"')).alias("v")).orderBy("doc_id").coalesce(1)
        tables.write_lines(lines, f"{path}/{name}.jsonl", "v")
    return tables.read_column_files(t._spark, path, {"id": "string", "lang": "string"})


@query("SELECT c_mktsegment || '/' || c_custkey AS full_name, CASE WHEN c_custkey % 2 = 0 THEN 'test' ELSE 'val' END AS source FROM customer")
def repository_lists_read(t):
    path = _path(t, "lists")
    name = t.customer.select("c_custkey", F.concat_ws("/", "c_mktsegment", "c_custkey").alias("v"))
    tables.write_lines(name, f"{path}/val.txt", "v")
    tables.write_lines(name.where("c_custkey % 2 = 0"), f"{path}/test.txt", "v")
    return tables.read_repositories(t._spark, [f"{path}/val.txt", f"{path}/test.txt"])


@query("SELECT o_custkey::INT AS idxs, max(o_totalprice) AS logit_1 FROM orders GROUP BY 1")
def scored_csv_read(t):
    path = _path(t, "scores")
    tables.write_csv(t.orders.select(F.col("o_custkey").alias("idxs"), F.col("o_totalprice").alias("logit_1"), F.lit('a, "b"').alias("pred_assertion")), path)
    return tables.read_scored_csv(t._spark, path).select("idxs", "logit_1")


@query("SELECT conv_id * 100 + turn AS id, 'm { ' || role || ' <AssertPlaceHolder> } f' AS source, role AS target FROM conversations")
def text_pairs(t):
    one = lambda x: F.array(F.lit(x))
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), one("m").alias("test_sign_toks"), F.array(F.array("role"), one("x")).alias("test_stmt_toks"), one("f").alias("focalm_toks"), F.array("role").alias("gold"))
    source = exports.source_text("test_sign_toks", "test_stmt_toks", F.lit(1), "focalm_toks", exports.PLACEHOLDER)
    return rows.select("id", source.alias("source"), F.array_join("gold", " ").alias("target"))


@query("SELECT doc_id::INT AS id, quality::DOUBLE AS quality FROM labels")
def predictions_written(t):
    path = _path(t, "predictions")
    rows = t.labels.select(F.col("doc_id").cast("int").alias("id"), F.lit("x").alias("data_id"), F.create_map(F.lit("quality"), F.col("quality").cast("double")).alias("metrics"))
    tables.write_predictions(rows, path)
    return tables.read_predictions(t._spark, path, metrics_only=True).select("id", F.col("metrics")["quality"].alias("quality"))


@query("SELECT p_partkey AS pos, p_name AS name, p_brand AS brand FROM part")
def zipped_columns(t):
    return tables.zipped({"name": t.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("value")), "brand": t.part.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("value"))})


@query("SELECT p_partkey AS pos, p_name FROM part WHERE p_partkey IN (3, 17, 5)")
def rows_at_places(t):
    return tables.rows_at(t.part.select(F.col("p_partkey").alias("pos"), "p_name"), [17, 3, 5])


@query("SELECT DISTINCT o_custkey AS proj_name FROM orders WHERE o_orderstatus = 'F'")
def used_projects(t):
    data = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("proj_name"))
    return tables.used_projects(t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("data_id")), data)


@query("SELECT c_custkey, length(c_name)::BIGINT AS n FROM customer")
def mapped_rows(t):
    return visitors.mapped(t.customer.select("c_custkey", "c_name"), lambda pdf: pdf[["c_custkey"]].assign(n=pdf["c_name"].str.len()), "c_custkey long, n long", 4)


@query("SELECT c_custkey, upper(c_mktsegment) AS upper, length(c_name)::INT AS n FROM customer")
def processed_rows(t):
    return visitors.processed(t.customer.select("c_custkey", "c_mktsegment", "c_name"), {"upper": lambda: F.upper("c_mktsegment"), "n": lambda: F.length("c_name")}).select("c_custkey", "upper", "n")


# streams


def _stream(t, name: str) -> DataFrame:
    """A table as a stream, whether it is a file or a folder of files. They come in one batch, since the order of a
    key's rows doesn't follow that of files."""
    # as a pattern, since a stream takes a plain path for a folder
    return tables.read_stream(t._spark, f"{t._dir}/{name}.parque[t]", getattr(t, name).schema, "*", None)


def _streamed(t, df, name: str) -> DataFrame:
    path = _path(t, name)
    query_ = changes.append_batches(df, path, _path(t, f"{name}-state")).trigger(availableNow=True).start()
    query_.awaitTermination()
    return t._spark.read.schema(df.schema).parquet(path)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE r = 1 OR value <> before")
def streamed_changes(t):
    rows = _stream(t, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return _streamed(t, changes.changed_values(rows), "changes").select("user_id", "event_type", "event_id", "value")


@query("SELECT conv_id::VARCHAR AS session, turn AS seq, string_agg(turn::VARCHAR, ' ') OVER (PARTITION BY conv_id ORDER BY turn) AS state FROM conversations WHERE turn > 0")
def streamed_sessions(t):
    command = F.when(F.col("turn") == 0, "start").otherwise("submit")
    rows = _stream(t, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), command.alias("command"), F.col("turn").cast("string").alias("argument"))
    return _streamed(t, changes.sessions(rows), "sessions").where("command = 'submit'").select("session", "seq", "state")


# plans


@query("""SELECT conv_id AS id, n::BIGINT AS n, array_to_string(list_transform(range(0, n + 1), lambda i: CASE WHEN u > 0 AND i >= u THEN 'user' ELSE '-' END), ',') AS fields_set,
array_to_string(list_transform(range(0, n + 1), lambda i: CASE WHEN i > 0 AND roles[i] <> 'system' THEN roles[i] ELSE '-' END), ',') AS called
FROM (SELECT conv_id, count(*) AS n, coalesce(min(turn) FILTER (role = 'user'), -1) + 1 AS u, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1)""")
def enriched_tests(t):
    c = t.conversations.select(F.col("conv_id").alias("id"), "turn", "role")
    n_steps = c.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    given = {
        "n_steps": n_steps,
        "class_methods": c.select(F.col("id").alias("cid"), F.col("turn").alias("mid"), F.array(F.lit("org.junit.Before")).alias("annotations")),
        "fields": n_steps.select("id", F.lit("user").alias("name")),
        "fields_first": c.where("role = 'user'").select("id", F.col("role").alias("name"), (F.col("turn") + 1).alias("step")),
        "called": c.select("id", (F.col("turn") + 1).cast("int").alias("step"), F.lit(0).alias("i"), F.array_repeat("role", F.when(F.col("role") == "system", 201).otherwise(1)).alias("toks")),
    }
    tests = n_steps.withColumn("cid", F.col("id"))
    got = stages.enrich(tests, ["fields_set_notset", "last_called_method"], given)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(F.get(x, 0), F.lit("-"))), ",")
    return got.select("id", F.col("n").cast("long").alias("n"), shown("fields_set").alias("fields_set"), shown("last_called_methods").alias("called"))
