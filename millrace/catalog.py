"""Queries over the driver's tables: each runs an operator on a stand-in view and has SQL that DuckDB can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import metrics as M
from millrace.functions import names as N
from millrace.functions import tokens as T
from millrace.functions.base import words
from millrace.operators import filters, focal, ranking, resolve, retrieval, sampling, summary, trees, tries, windows
from millrace.plans import stages
from millrace.registry import Tables, oracle_sql, queries, query  # noqa: F401 (offered from here)
from millrace.sources import tables

FULL_KEY = ["l_linenumber", "l_partkey", "l_suppkey"]
COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

# scans, joins, filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_project_columns(t):
    rows = tables.read_columns(t._spark, f"{t._dir}/orders.parquet", only=["o_orderkey", "o_totalprice", "o_orderstatus", "no_such"])
    return rows.where("o_orderstatus = 'F'").drop("o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_expected_ids(t):
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.read_ids(t.orders, ids, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_join_skip_list(t):
    skip = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return filters.allowed(t.customer, skip, "c_custkey", deny=True).select("c_custkey", "c_name")


@query("SELECT c_mktsegment AS sources, count(*) AS n, min(o_orderkey) AS first_id FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def project_inner_join(t):
    repos = t.customer.select(F.col("c_custkey").alias("proj_name"), F.col("c_mktsegment").alias("sources"))
    rows = sampling.splits(t.orders.withColumnRenamed("o_custkey", "proj_name"), repos)
    return rows.groupBy("sources").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))


@query("SELECT c_mktsegment AS sources, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS ids FROM customer GROUP BY 1")
def split_ids(t):
    got = sampling.split_ids(t.customer, "c_mktsegment", "c_custkey")
    return got.select(F.col("c_mktsegment").alias("sources"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def _rules():
    return [("returned", F.col("l_returnflag") == "R"), ("small", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08), ("expensive", F.col("l_extendedprice") > 50000), ("never", F.col("l_quantity") < 0)]
_REASON = "CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_extendedprice > 50000 THEN 'expensive' WHEN l_quantity < 0 THEN 'never' END"


@query(f"SELECT {COLS} FROM lineitem WHERE {_REASON} IS NULL")
def filter_cascade_kept(t):
    return filters.kept(t.lineitem, _rules()).select("l_orderkey", *FULL_KEY)


@query(f"SELECT r.reason, count(x.reason) AS n FROM (SELECT unnest(['returned','small','discounted','expensive','never']) AS reason) r LEFT JOIN (SELECT {_REASON} AS reason FROM lineitem) x ON r.reason = x.reason GROUP BY 1")
def filter_cascade_counters(t):
    return filters.counters(t.lineitem, _rules())


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE n >= 8 AND r <= 12")
def project_min_max_cap(t):
    return filters.size_between(t.orders, "o_custkey", 8, 12, ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS r FROM part) WHERE r = 1")
def dedup_first_wins(t):
    return filters.first_wins(t.part, ["p_name"], ["p_brand", "p_partkey"]).select("p_name", "p_partkey", "p_brand")


@query("SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS r FROM part) WHERE r = 1")
def dedup_last_wins(t):
    return filters.last_wins(t.part, ["p_name"], "p_partkey").select("p_name", "p_partkey")


@query("SELECT p_partkey, (p_size & 1) <> 0 AS public, (p_size & 2) <> 0 AS private, (p_size & 4) <> 0 AS protected, (p_size & 8) <> 0 AS static, (p_size & 7) = 0 AS package_private FROM part")
def bitmask_flags(t):
    a = F.col("p_size")
    return t.part.select("p_partkey", *(N.has_flag(a, x).alias(x) for x in ("public", "private", "protected", "static")), N.is_package_private(a).alias("package_private"))


_NAMES = ["test", "Test_", "tEST_12", "test12", "testAll", "aTest", "test_x", "te st", ""]


@query("SELECT event_id, event_id % 9 < 4 AS bad FROM events")
def badly_named_regex(t):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 9 + 1).cast("int"))
    return t.events.select("event_id", name.rlike(filters.BAD_NAME).alias("bad"))


@query("SELECT conv_id, turn, CASE WHEN len(w) < 20 THEN 'short' WHEN len(w) > 60 THEN 'long' END AS reason FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\p{L}+') AS w FROM conversations)")
def array_size_filters(t):
    n = F.size(words(F.col("text")))
    return t.conversations.select("conv_id", "turn", filters.reject_reason([("short", n < 20), ("long", n > 60)]).alias("reason"))


@query("SELECT page_id, length(html) <= 1500 AND len(string_split(html, chr(10))) <= 2 AS small FROM pages")
def source_size_guard(t):
    return t.pages.select("page_id", filters.source_small_enough(F.col("html"), 1500, 2).alias("small"))


@query("SELECT doc_id, max(n) >= 10 AS degenerate FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents) GROUP BY 1, 2) GROUP BY 1")
def degenerate_texts(t):
    rows = t.documents.select("doc_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    return rows.select("doc_id", filters.degenerate(F.col("w")).alias("degenerate"))


# names

_TYPES = ["int", "long[]", "boolean[][]", "java.lang.String", "a.b.C$D[]", "void"]


@query("SELECT p_partkey, t || b AS name, repeat('[', (length(b) / 2)::INT) || CASE t WHEN 'int' THEN 'I' WHEN 'short' THEN 'S' ELSE 'L' || replace(t, '.', '/') || ';' END AS descriptor FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'short' ELSE 'x.y.' || replace(p_name, ' ', '_') END AS t, repeat('[]', p_size % 4) AS b FROM part)")
def name_to_descriptor(t):
    base = F.when(F.col("p_size") % 3 == 0, "int").when(F.col("p_size") % 3 == 1, "short").otherwise(F.concat(F.lit("x.y."), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))))
    name = F.concat(base, F.repeat(F.lit("[]"), F.col("p_size") % 4))
    return t.part.select("p_partkey", name.alias("name"), N.type_descriptor(name).alias("descriptor"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'int' ELSE replace(p_name, ' ', '_') END || repeat('[]', p_size % 4) AS simple FROM part")
def simplify_type_name(t):
    n = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    base = F.when(F.col("p_size") % 3 == 0, F.lit("I")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Lx/y/"), n, F.lit(";"))).otherwise(F.concat(F.lit("x.y."), n))
    return t.part.select("p_partkey", N.simplify_type(F.concat(F.repeat(F.lit("["), F.col("p_size") % 4), base)).alias("simple"))


@query("SELECT doc_id, 'L' || lang || '; ' || source || ' x' AS stripped FROM documents")
def strip_package(t):
    token = F.concat(F.lit("La/b_1/"), "lang", F.lit("; com/x/"), "source", F.lit(" x"))
    return t.documents.select("doc_id", N.strip_package(token).alias("stripped"))


@query("SELECT p_partkey, 'I|[[Lx/' || replace(p_name, ' ', '') || ';|[J|Z' AS types, 4::INT AS n FROM part")
def split_descriptor(t):
    types = N.split_descriptor(F.concat(F.lit("I[[Lx/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("")), F.lit(";[JZ")))
    return t.part.select("p_partkey", F.array_join(types, "|").alias("types"), F.size(types).alias("n"))


@query("SELECT c_custkey, 'org/x/' || c_mktsegment || '#' || replace(c_name, '#', '') || '(I[Lorg/Y;)V' AS key, 'org.x.' || c_mktsegment AS cls, replace(c_name, '#', '') AS method FROM customer")
def method_keys(t):
    key = N.method_key(F.concat(F.lit("org.x."), "c_mktsegment"), F.replace(F.col("c_name"), F.lit("#"), F.lit("")), F.array(F.lit("int"), F.lit("org.Y[]")), F.lit("void"))
    cls, method = N.split_method_key(key)
    return t.customer.select("c_custkey", key.alias("key"), cls.alias("cls"), method.alias("method"))


_OPS = ["INVOKEVIRTUAL", "GETFIELD", "GOTO", "LABEL", "POP"]


@query("SELECT p_partkey, ['method','field','jump','label','other'][(p_size % 5) + 1] AS class, CASE WHEN p_size % 5 = 0 THEN 3 END AS arguments FROM part")
def instruction_classes(t):
    insn = F.array(F.element_at(F.array(*map(F.lit, _OPS)), F.col("p_size") % 5 + 1), F.lit("a/B"), F.lit("m"), F.lit("(I[La/C;)V"))
    return t.part.select("p_partkey", N.insn_class(insn).alias("class"), F.when(N.is_method_insn(insn), N.insn_argument_count(insn)).alias("arguments"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber < 2 THEN false ELSE l_partkey % 2 = 0 END AS fits FROM lineitem")
def overload_match(t):
    # a stack of references with an int on top for even parts; the method takes (reference, int-like)
    stack = F.concat(F.array_repeat(F.lit("La/B;"), F.col("l_linenumber") - 1), F.array(F.when(F.col("l_partkey") % 2 == 0, "I").otherwise("J")))
    return t.lineitem.select("l_orderkey", *FULL_KEY, N.accepts(stack, F.array(F.lit("[I"), F.lit("Z"))).alias("fits"))


# tokens

_W = r"regexp_extract_all(text, '\p{L}+')"


@query("SELECT c_custkey, '|' || lower(c_mktsegment) || '|case|' || c_custkey || '|_|x|' AS parts FROM customer")
def subtoken_split(t):
    return t.customer.select("c_custkey", F.array_join(T.subtokens(F.concat(F.col("c_mktsegment"), F.lit("Case"), F.col("c_custkey"), F.lit("_x"))), "|").alias("parts"))


@query(f"SELECT doc_id, len({_W})::INT AS n, array_to_string({_W}, ' ') AS words FROM documents")
def tokenize_words(t):
    w = words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).alias("n"), T.joined(w).alias("words"))


@query(f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS gram FROM (SELECT {_W} AS w FROM documents)) GROUP BY 1")
def ngrams_count(t):
    grams = t.documents.select(words(F.col("text")).alias("w")).select(F.explode(T.ngrams(F.col("w"), 2, "_")).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT conv_id, turn, array_to_string(list_concat(w[1:30], list_transform(range(0, greatest(30 - len(w), 0)), lambda i: '_')), ' ') AS padded, array_to_string(w[greatest(len(w) - 4, 1):], ' ') AS tail FROM (SELECT conv_id, turn, {_W} AS w FROM conversations)")
def pad_truncate(t):
    rows = t.conversations.select("conv_id", "turn", words(F.col("text")).alias("w"))
    return rows.select("conv_id", "turn", T.joined(T.pad(F.col("w"), 30, F.lit("_"))).alias("padded"), T.joined(T.keep_last(F.col("w"), 5)).alias("tail"))


@query(f"SELECT conv_id, turn, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 2 AND w[i - 1] = w[1] THEN 'STR' ELSE x END), ' ') AS masked FROM (SELECT conv_id, turn, {_W} AS w FROM conversations)")
def mask_literals(t):
    rows = t.conversations.select("conv_id", "turn", words(F.col("text")).alias("w"))
    masked = F.transform("w", lambda x, i: F.when((i >= 2) & (F.get("w", i - 1) == F.get("w", F.lit(0))), F.lit("STR")).otherwise(x))
    return rows.select("conv_id", "turn", T.joined(masked).alias("masked"))


@query("SELECT conv_id, n, array_to_string(roles[1:n // 2], ',') AS roles, array_to_string(roles[1:n // 2 + 1], ',') AS states FROM (SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1)")
def cutoff_prefix(t):
    per = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x")).select("conv_id", "n", F.col("x.role").alias("roles"), F.col("x.role").alias("states"))
    cut = sampling.cut_off(per, F.floor(F.col("n") / 2).cast("int"), ["roles"], ["states"])
    return cut.select("conv_id", "n", F.array_join("roles", ",").alias("roles"), F.array_join("states", ",").alias("states"))


@query("SELECT conv_id, string_agg(role || ' : ' || text, ' </s> ' ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def sequence_assembly(t):
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return turns.select("conv_id", F.array_join(F.transform("x", lambda r: F.concat_ws(" : ", r["role"], r["text"])), " </s> ").alias("prompt"))


@query(f"SELECT conv_id, turn, len(w)::INT AS n_text, (2 + len(w))::INT AS n FROM (SELECT conv_id, turn, {_W} AS w FROM conversations)")
def tokens_with_inputs(t):
    rows = t.conversations.select("conv_id", "turn", T.with_inputs([("role", F.array("role")), ("text", words(F.col("text")))], "</s>").alias("x"))
    return rows.select("conv_id", "turn", F.size(F.filter("x", lambda r: r["input"] == "text")).alias("n_text"), F.size("x").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS squeezed FROM documents")
def squeeze_space(t):
    return t.documents.select("doc_id", T.squeeze(F.col("text")).alias("squeezed"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 96) || '...' || right(text, 1) ELSE text END AS shown FROM documents")
def shorten_values(t):
    return t.documents.select("doc_id", T.shorten(F.col("text")).alias("shown"))


_LITERALS = ["12", "-7", "0.5", "-.5", "1.5E-3", "2E8", "NaN", "-Infinity", "Infinity", "+1", "5.", "1e5", "-NaN", "", "x", "--1"]


@query("SELECT event_id, event_id % 16 < 9 AS number FROM events")
def number_literals(t):
    v = F.element_at(F.array(*map(F.lit, _LITERALS)), (F.col("event_id") % 16 + 1).cast("int"))
    return t.events.select("event_id", T.is_number(v).alias("number"))


@query(f"SELECT conv_id, turn, array_to_string(CASE WHEN p > 0 THEN list_append(w[1:p - 1], 'a') ELSE w END, ' ') AS kept FROM (SELECT *, coalesce(list_position(list_transform(w, lambda x: starts_with(x, 'a')), true), 0) AS p FROM (SELECT conv_id, turn, {_W} AS w FROM conversations))")
def cut_predictions(t):
    rows = t.conversations.select("conv_id", "turn", words(F.col("text")).alias("w"))
    return rows.select("conv_id", "turn", T.joined(T.cut_at(F.col("w"), "a")).alias("kept"))


# class hierarchies: part p extends part p div 2

_CLASSES = "SELECT p_partkey AS cid, CASE WHEN p_partkey // 2 > 0 THEN p_partkey // 2 END AS ext FROM part"
_UP = f"WITH RECURSIVE c AS ({_CLASSES}), up AS (SELECT cid, cid AS ancestor, 0 AS depth FROM c UNION ALL SELECT up.cid, c.ext, depth + 1 FROM up JOIN c ON up.ancestor = c.cid WHERE c.ext IS NOT NULL)"


def _classes(t):
    cid = F.col("p_partkey")
    ext = F.floor(cid / 2)
    impl = F.when(cid % 3 == 0, F.array((cid / 3).cast("long"))).otherwise(F.array().cast("array<long>"))
    return t.part.select(cid.alias("cid"), F.when(ext > 0, ext).alias("ext"), impl.alias("impl"), F.concat(F.lit("c"), cid).alias("name"), F.lit(1).alias("access"), "p_size", "p_name")


@query(f"{_UP} SELECT cid, ancestor, depth FROM up")
def ancestor_chain(t):
    c = _classes(t)
    return resolve.superclasses(c, c)


@query(f"{_UP}, m AS (SELECT p_partkey AS mid, p_partkey AS cid, p_name AS namedesc FROM part WHERE p_partkey % 3 = 1), q AS (SELECT p_partkey AS cid, p_name AS namedesc FROM part) SELECT q.cid, q.namedesc, arg_min(m.mid, up.depth) AS mid FROM q JOIN up USING (cid) LEFT JOIN m ON m.cid = up.ancestor AND m.namedesc = q.namedesc GROUP BY 1, 2")
def virtual_lookup(t):
    c = _classes(t).withColumn("impl", F.array().cast("array<long>"))
    methods = c.where("cid % 3 = 1").select(F.col("cid").alias("mid"), "cid", F.col("p_name").alias("namedesc"), F.lit(1).alias("access"))
    asked = c.select("cid", F.col("p_name").alias("namedesc"), F.lit("INVOKEVIRTUAL").alias("op"))
    return resolve.lookup_methods(asked, c, methods).select("cid", "namedesc", F.col("mid").cast("long").alias("mid"))


@query(f"{_UP}, f AS (SELECT p_partkey AS fid, p_partkey AS cid, 'f' || p_size % 7 AS name FROM part WHERE p_partkey % 2 = 1), q AS (SELECT p_partkey AS cid, 'f' || p_partkey % 7 AS name FROM part), places AS (SELECT cid, depth, -1 AS pos, ancestor AS place FROM up UNION ALL SELECT cid, depth, 0, ancestor // 3 FROM up WHERE ancestor % 3 = 0), hit AS (SELECT q.cid, q.name, f.fid, depth, pos FROM q JOIN places USING (cid) JOIN f ON f.cid = place AND f.name = q.name) SELECT q.cid, q.name, (SELECT arg_min(fid, depth * 2 + pos) FROM hit WHERE hit.cid = q.cid AND hit.name = q.name) AS fid FROM q")
def field_lookup(t):
    c = _classes(t)
    fields = c.where("cid % 2 = 1").select(F.col("cid").alias("fid"), "cid", F.concat(F.lit("f"), F.col("p_size") % 7).alias("name"))
    return resolve.lookup_fields(c.select("cid", F.concat(F.lit("f"), F.col("cid") % 7).alias("name")), c.drop("name"), fields).select("cid", "name", F.col("fid").cast("long").alias("fid"))


@query(f"WITH e AS ({_CLASSES}), r AS (SELECT cid AS root, cid AS node FROM e UNION SELECT cid, ext FROM e WHERE ext IS NOT NULL UNION SELECT a.cid, b.ext FROM e a JOIN e b ON a.ext = b.cid WHERE b.ext IS NOT NULL) SELECT DISTINCT root, p_size::BIGINT AS fid FROM r JOIN part ON p_partkey = node WHERE p_size % 2 = 0")
def transitive_fields_set(t):
    c = _classes(t)
    calls = c.where("ext is not null").select(F.col("cid").alias("src"), F.col("ext").alias("dst"))
    puts = c.where("p_size % 2 = 0").select(F.col("cid").alias("mid"), F.col("p_size").alias("fid"))
    got = resolve.fields_set(calls, puts, c.select(F.col("cid").alias("root"), F.col("cid").alias("node")), 2)
    return got.select(F.col("root").cast("long").alias("root"), F.col("fid").cast("long").alias("fid"))


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 'out' AS side FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 'in' FROM lineitem WHERE l_suppkey = 3")
def edges_from_to(t):
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return resolve.edges_from(e, 7).withColumn("side", F.lit("out")).union(resolve.edges_to(e, 3).withColumn("side", F.lit("in")))


@query(f"{_UP}, m AS (SELECT p_partkey AS mid, p_partkey AS cid, 'm' || p_size % 5 AS namedesc FROM part) SELECT a.mid, arg_max(b.mid, depth) AS overridden FROM m a JOIN up ON up.cid = a.cid AND depth > 0 JOIN m b ON b.cid = up.ancestor AND b.namedesc = a.namedesc GROUP BY 1")
def override_edges(t):
    c = _classes(t).withColumn("impl", F.array().cast("array<long>"))
    methods = c.select(F.col("cid").alias("mid"), "cid", F.concat(F.lit("m"), F.col("p_size") % 5).alias("namedesc"), "access")
    return resolve.override_edges(c, methods).select(F.col("mid").cast("long").alias("mid"), F.col("overridden").cast("long").alias("overridden"))


# focal methods: the lines of an order are its calls

_CALLS = "SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_partkey AS mid, l_partkey % 10 AS cid, l_returnflag <> 'R' AND l_linestatus = 'O' AS mine, l_quantity > 45 AS is_assertion, l_orderkey % 10 AS focal_cid FROM lineitem"


@query(f"""WITH c AS ({_CALLS}), s AS (SELECT id, min(i) FILTER (is_assertion) AS stop FROM c GROUP BY 1),
m AS (SELECT c.*, coalesce(i < stop, true) AS early, cid = focal_cid AS own FROM c JOIN s USING (id) WHERE mine),
g AS (SELECT id, count(*) AS n, count(*) FILTER (own) AS k, arg_max(mid, i) AS last, arg_max(mid, i) FILTER (early) AS last_early, arg_max(mid, i) FILTER (own) AS own_last, arg_max(mid, i) FILTER (own AND early) AS own_early FROM m GROUP BY 1)
SELECT id, CASE WHEN n = 1 THEN last WHEN k = 1 THEN own_last WHEN k > 1 AND own_early IS NOT NULL THEN own_early WHEN last_early IS NOT NULL THEN last_early ELSE last END AS mid,
CASE WHEN n = 1 THEN 'only' WHEN k = 1 THEN 'only_in_class' WHEN k > 1 AND own_early IS NOT NULL THEN 'class_before_assertion' WHEN last_early IS NOT NULL THEN 'before_assertion' ELSE 'last' END AS rule FROM g""")
def focal_cascade(t):
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*FULL_KEY)) - 1
    mine = (F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "O")
    calls = t.lineitem.select(F.col("l_orderkey").alias("id"), i.alias("i"), F.col("l_partkey").alias("mid"), (F.col("l_partkey") % 10).alias("cid"), F.when(mine, "APP").otherwise("LIB").alias("scope"), F.lit(True).alias("has_code"), (F.col("l_quantity") > 45).alias("is_assertion"), (F.col("l_orderkey") % 10).alias("focal_cid"))
    return focal.focal_methods(calls)


# windows


@query("SELECT event_id, s.o_orderkey AS span FROM events e JOIN (SELECT o_orderkey, o_orderkey % 500 AS a, o_orderkey % 500 + o_custkey % 7 AS b, o_orderkey % 100 AS g FROM orders) s ON s.g = e.user_id % 100 AND e.event_id % 500 BETWEEN a AND b")
def line_interval_join(t):
    spans = t.orders.select(F.col("o_orderkey").alias("span"), (F.col("o_orderkey") % 100).alias("g"), (F.col("o_orderkey") % 500).alias("a"), (F.col("o_orderkey") % 500 + F.col("o_custkey") % 7).alias("b"))
    points = t.events.select("event_id", (F.col("user_id") % 100).alias("g"), (F.col("event_id") % 500).alias("at"))
    return windows.interval_join(points, spans, ["g"], "at", "a", "b", width=20).select("event_id", "span")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS known FROM events")
def asof_fill(t):
    return windows.last_known(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "known").select("event_id", "known")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last_user FROM conversations")
def last_called(t):
    return windows.last_known(t.conversations, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "last_user").select("conv_id", "turn", "last_user")


@query("SELECT event_id, user_id, event_type, level FROM (SELECT *, lag(level) OVER w AS before, row_number() OVER w AS r FROM (SELECT *, floor(value / 50)::BIGINT AS level FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE r = 1 OR level IS DISTINCT FROM before")
def runtime_delta(t):
    e = t.events.withColumn("level", F.floor(F.col("value") / 50))
    return windows.changes(e, ["user_id", "event_type"], ["ts", "event_id"], "level").select("event_id", "user_id", "event_type", "level")


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events), s AS (SELECT user_id, step FROM e) SELECT s.user_id, s.step, e.event_type, arg_max(e.value, e.step) AS value FROM s JOIN e ON e.user_id = s.user_id AND e.step <= s.step GROUP BY 1, 2, 3")
def runtime_full_state(t):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return windows.full_state(t.events.withColumn("step", step.cast("long")), "user_id", "step", "event_type", "value")


@query(f"WITH c AS (SELECT *, {_W} AS w, coalesce(sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM conversations) SELECT conv_id, turn, coalesce(array_to_string(flatten(list(w) OVER (PARTITION BY conv_id, seg ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)), ' '), '') AS context FROM c")
def prev_context_window(t):
    rows = t.conversations.withColumn("w", words(F.col("text")))
    return windows.previous_context(rows, ["conv_id"], ["turn"], "w", 2, F.col("role") == "system").select("conv_id", "turn", T.joined(F.col("context")).alias("context"))


@query("""WITH n AS (SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT id, unnest(range(0, n + 1)) AS step FROM n),
w AS (SELECT s.id, s.step, k.name, (SELECT min(turn) + 1 FROM conversations c WHERE c.conv_id = s.id AND c.role = k.name) AS f FROM s, (SELECT unnest(['user','assistant','system']) AS name) k)
SELECT id, step, coalesce(string_agg(name, ',' ORDER BY name) FILTER (f <= step), '') AS names_set, coalesce(string_agg(name, ',' ORDER BY name) FILTER (f IS NULL OR f > step), '') AS names_notset FROM w GROUP BY 1, 2""")
def fields_set_by_step(t):
    c = t.conversations.withColumnRenamed("conv_id", "id")
    n = c.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    every = n.select("id", F.explode(F.array(*map(F.lit, ("user", "assistant", "system")))).alias("name"))
    got = windows.set_by_step(n, c.select("id", F.col("role").alias("name"), (F.col("turn") + 1).alias("step")), every, "id", "name")
    return got.select("id", F.col("step").cast("long").alias("step"), F.array_join("names_set", ",").alias("names_set"), F.array_join("names_notset", ",").alias("names_notset"))


@query("""WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, 't' || l_suppkey % 4 AS t, l_quantity > 40 AS focal FROM lineitem),
n AS (SELECT id, count(*) AS n FROM l GROUP BY 1), s AS (SELECT id, unnest(range(0, n + 1)) AS step FROM n), g AS (SELECT id, t, min(i) + 1 AS gone FROM l GROUP BY 1, 2), f AS (SELECT id, min(i) + 1 AS called FROM l WHERE focal GROUP BY 1),
x AS (SELECT s.id, s.step, k.t, gone, called FROM s, (SELECT unnest(['t0','t1','t2']) AS t) k LEFT JOIN g ON g.id = s.id AND g.t = k.t LEFT JOIN f ON f.id = s.id)
SELECT id, step, coalesce(string_agg(t, ',' ORDER BY t) FILTER ((gone IS NULL OR step < gone) AND (called IS NULL OR step <= called)), '') AS absent FROM x GROUP BY 1, 2""")
def types_absent(t):
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*FULL_KEY)) - 1
    calls = t.lineitem.select(F.col("l_orderkey").alias("id"), i.alias("step"), F.concat(F.lit("t"), F.col("l_suppkey") % 4).alias("type"), (F.col("l_quantity") > 40).alias("focal"))
    n = calls.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    wanted = n.select("id", F.explode(F.array(*map(F.lit, ("t0", "t1", "t2")))).alias("type"))
    got = windows.types_absent(n, wanted, calls.select("id", "step", "type"), calls.where("focal").select("id", "step"))
    return got.select("id", F.col("step").cast("long").alias("step"), F.array_join("absent", ",").alias("absent"))


@query("SELECT conv_id AS id, stmt_i FROM (SELECT conv_id, min(turn) AS stmt_i FROM conversations WHERE role = 'assistant' GROUP BY 1) WHERE stmt_i >= 2")
def first_assertion(t):
    per = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    tests = per.select("id", F.transform("x", lambda r: F.array(F.when(r["role"] == "assistant", F.lit("assertThat")).otherwise(r["role"]))).alias("test_stmt_toks"))
    return sampling.places(tests, first_assertion=True, min_stmt=2).select("id", F.col("stmt_i").cast("long").alias("stmt_i"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM conversations), c AS (SELECT *, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY round, conv_id) AS k FROM r) SELECT conv_id, turn FROM c WHERE k <= 40 ORDER BY round, conv_id LIMIT 150")
def round_robin_sample(t):
    rows = t.conversations.withColumn("proj", F.col("conv_id") % 5)
    return sampling.round_robin(rows, "conv_id", ["turn"], ["conv_id"], 150, "proj", 40).select("conv_id", "turn")


@query("SELECT c_custkey, 'csn-' || (row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) AS new_id FROM customer")
def dense_renumber(t):
    return windows.renumbered(t.customer, ["c_mktsegment", "c_custkey"], prefix="csn-").select("c_custkey", "new_id")


@query("SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4)::INT AS chunk FROM orders")
def chunk_batches(t):
    return windows.chunks(t.orders, ["o_custkey"], ["o_orderkey"], 4).select("o_custkey", "o_orderkey", "chunk")


@query("SELECT event_id, coalesce(first_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 'END') AS next_op FROM events")
def next_operation(t):
    return windows.next_op(t.events, ["user_id"], ["event_id"], "event_type", ["view"]).select("event_id", "next_op")


@query("SELECT o_orderkey, coalesce(a <= lag(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey), false) AS overlaps FROM (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS a, epoch_us(o_orderdate) // 86400000000 + 20 AS b FROM orders)")
def lines_overlap(t):
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    rows = t.orders.select("o_orderkey", "o_custkey", day.alias("first")).withColumn("last", F.col("first") + 20)
    return windows.lines_overlap(rows, ["o_custkey"], ["first", "o_orderkey"]).select("o_orderkey", "overlaps")


# retrieval

_BM25 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w FROM documents), q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(text, '\p{L}+')) AS w FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
x AS (SELECT doc_id, tf.term, tf * (ln(n / df) + 1) AS x, ln(n / df) + 1 AS idf FROM tf JOIN df USING (term), n), l AS (SELECT doc_id, sum(x) AS len FROM x GROUP BY 1), a AS (SELECT sum(len) / max(n) AS avdl FROM l, n),
s AS (SELECT query_id, x.doc_id, sum(x * (idf - 1) * 2.6 / (x + 1.6 * (0.25 + 0.75 * len / avdl))) AS score FROM (SELECT query_id, unnest(w) AS term FROM q) q JOIN x USING (term) JOIN l USING (doc_id), a GROUP BY 1, 2)"""


def _bm25(t):
    indexed = retrieval.index(t.documents.select("doc_id", words(F.col("text")).alias("toks")))
    return retrieval.scores(t.benchmark.select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("toks")), indexed)


@query(_BM25 + " SELECT query_id, count(*) AS n, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM s GROUP BY 1")
def bm25_scores(t):
    return _bm25(t).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


@query(_BM25 + " SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r = 1")
def bm25_top1(t):
    return retrieval.best(_bm25(t)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


# metrics: benchmark items as gold, the documents of equal remainder as ranked predictions

_PAIRS = r"WITH n AS (SELECT count(*) AS n FROM benchmark), p AS (SELECT item_id, doc_id, rank, regexp_extract_all(b, '\p{L}+') AS g, regexp_extract_all(x, '\p{L}+') AS p FROM (SELECT item_id, d.doc_id, benchmark.text AS b, d.text AS x, row_number() OVER (PARTITION BY item_id ORDER BY d.doc_id) AS rank FROM benchmark, n JOIN documents d ON d.doc_id % n.n = item_id))"


def _ranked(t) -> DataFrame:
    """(item_id, doc_id, rank, g, p)."""
    n = t.benchmark.count()
    both = t.benchmark.select("item_id", words(F.col("text")).alias("g")).join(t.documents.select("doc_id", (F.col("doc_id") % n).alias("item_id"), F.col("text")), "item_id")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id")))
    # few bytes, but much to compute for each row: one partition a core
    return ranked.repartition(t._spark.sparkContext.defaultParallelism).select("item_id", "doc_id", "rank", "g", words(F.col("text")).alias("p"))


_MATCH = "CASE WHEN len(g) = 0 OR len(p) = 0 THEN 0 WHEN g = p THEN 100 ELSE 0 END"


@query(_PAIRS + f" SELECT item_id, max({_MATCH}) FILTER (rank = 1) AS xmatch, max({_MATCH}) FILTER (rank <= 3) AS xmatch_top3, max({_MATCH}) FILTER (rank <= 10) AS xmatch_top10 FROM p GROUP BY 1")
def xmatch_topk(t):
    m = M.exact_match(F.col("g"), F.col("p"))
    of = lambda k: F.max(F.when(F.col("rank") <= k, m)).alias("xmatch" if k == 1 else f"xmatch_top{k}")
    return _ranked(t).groupBy("item_id").agg(of(1), of(3), of(10))


@query(_PAIRS + " SELECT item_id, doc_id, CASE WHEN least(len(g), len(p)) = 0 THEN 0 ELSE round(100.0 * len(list_filter(range(1, least(len(g), len(p)) + 1), lambda i: g[i] = p[i])) / least(len(g), len(p)), 6) END::DOUBLE AS acc FROM p")
def token_accuracy(t):
    return _ranked(t).select("item_id", "doc_id", F.round(M.token_accuracy(F.col("g"), F.col("p")), 6).alias("acc"))


def _orders(side: str, table: str = "p") -> str:
    return " UNION ALL ".join(f"SELECT item_id, doc_id, {n} AS k, unnest(list_transform(range(1, len({side}) - {n - 2}), lambda i: array_to_string({side}[i:i + {n - 1}], chr(1)))) AS gram FROM {table}" for n in range(1, 5))


_CLIP = f"""{_PAIRS}, gg AS (SELECT item_id, doc_id, k, gram, count(*) AS c FROM ({_orders('g')}) GROUP BY ALL), pg AS (SELECT item_id, doc_id, k, gram, count(*) AS c FROM ({_orders('p')}) GROUP BY ALL),
m AS (SELECT item_id, doc_id, k, sum(least(gg.c, pg.c)) AS a FROM gg JOIN pg USING (item_id, doc_id, k, gram) GROUP BY ALL),
f AS (SELECT item_id, doc_id, len(g) AS lg, len(p) AS lp, s.k, coalesce(a, 0)::DOUBLE AS a, greatest(len(p) - s.k + 1, 1)::DOUBLE AS b FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) s LEFT JOIN m USING (item_id, doc_id, k)),
bp AS (SELECT DISTINCT item_id, doc_id, lg, lp, CASE WHEN lp > lg THEN 1.0 WHEN lp = 0 THEN 0.0 ELSE exp(1 - lg::DOUBLE / lp) END AS bp FROM f)"""


@query(_CLIP + " SELECT item_id, doc_id, round(CASE WHEN lg = 0 OR lp = 0 OR sum(a) FILTER (k = 1) = 0 THEN 0 ELSE 100 * bp * exp(sum(ln((a + 1) / (b + 1)) / least(lp, 4)) FILTER (k <= lp)) END, 6)::DOUBLE AS bleu FROM f JOIN bp USING (item_id, doc_id, lg, lp) GROUP BY item_id, doc_id, lg, lp, bp")
def bleu_sentence(t):
    return _ranked(t).select("item_id", "doc_id", F.round(M.bleu(F.col("g"), F.col("p")), 6).alias("bleu"))


@query(_CLIP + ", s AS (SELECT k, sum(a) AS a, sum(b) AS b FROM f GROUP BY 1), l AS (SELECT sum(lg) AS lg, sum(lp) AS lp FROM bp) SELECT round(100 * CASE WHEN lp > lg THEN 1.0 ELSE exp(1 - lg / lp) END * (SELECT exp(sum(0.25 * ln(CASE WHEN a > 0 THEN a / b ELSE 0.1 / b END))) FROM s), 6) AS bleu FROM l")
def bleu_corpus(t):
    return _ranked(t).agg(*M.corpus_bleu_parts(F.col("g"), F.col("p"))).select(F.round(M.corpus_bleu(), 6).alias("bleu"))


_KEYWORDS = ["the", "of", "and", "to", "in"]
_KW = "gram IN ('the','of','and','to','in')"


@query(_CLIP + f""", w AS (SELECT item_id, doc_id, k, sum(c * CASE WHEN k = 1 AND NOT {_KW} THEN 0.2 ELSE 1 END) AS b FROM gg GROUP BY ALL),
h AS (SELECT item_id, doc_id, k, sum(least(gg.c, pg.c) * CASE WHEN k = 1 AND NOT {_KW} THEN 0.2 ELSE 1 END) AS a FROM gg JOIN pg USING (item_id, doc_id, k, gram) GROUP BY ALL),
z AS (SELECT f.item_id, f.doc_id, lg, lp, f.k, coalesce(h.a, 0)::DOUBLE AS a, coalesce(w.b, 1)::DOUBLE AS b FROM f LEFT JOIN w USING (item_id, doc_id, k) LEFT JOIN h USING (item_id, doc_id, k))
SELECT item_id, doc_id, round(CASE WHEN lg = 0 OR lp = 0 OR sum(a) FILTER (k = 1) = 0 THEN 0 ELSE 100 * bp * exp(sum(0.25 * ln(CASE WHEN a > 0 THEN a / b ELSE 0.1 / b END))) END, 6)::DOUBLE AS score FROM z JOIN bp USING (item_id, doc_id, lg, lp) GROUP BY item_id, doc_id, lg, lp, bp""")
def weighted_ngram(t):
    return _ranked(t).select("item_id", "doc_id", F.round(M.weighted_ngram(F.col("g"), F.col("p"), _KEYWORDS), 6).alias("score"))


_ASCII = "regexp_replace({}, '[^ -~]', '', 'g')"


def _ascii(c: str):
    return F.regexp_replace(c, "[^ -~]", "")


@query(f"SELECT a.conv_id, a.turn, levenshtein({_ASCII.format('a.text')}, {_ASCII.format('b.text')})::INT AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def edit_distance(t):
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return t.conversations.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.levenshtein(_ascii("text"), _ascii("after")).alias("distance"))


@query()
def edit_sim_indel(t):
    return _ranked(t).select("item_id", "doc_id", M.edit_similarity(T.joined(F.col("g")), T.joined(F.col("p"))).alias("sim"))


@query()
def rouge_l(t):
    r = _ranked(t).select("item_id", "doc_id", M.rouge_l(T.joined(F.col("g")), T.joined(F.col("p"))).alias("r"))
    return r.select("item_id", "doc_id", "r.*")


@query("SELECT source, round(CASE WHEN n - c < 3 OR n < 3 THEN 1 - pow(1 - c / n, 3) WHEN c = 0 THEN 0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 3.0::DOUBLE / i)) END, 9)::DOUBLE AS pass FROM (SELECT source, count(*) AS n, sum(quality)::BIGINT AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def pass_at_k(t):
    per = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("c"))
    return per.select("source", F.round(M.pass_at_k(F.col("n"), F.col("c"), 3), 9).alias("pass"))


@query("SELECT source, round(avg((r BETWEEN 1 AND 2)::INT), 9) AS top2 FROM (SELECT source, lang, coalesce(min(i) FILTER (quality = 0), 0) AS r FROM (SELECT source, lang, quality, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2) GROUP BY 1")
def topk_accuracy(t):
    i = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    first = t.documents.join(t.labels, "doc_id").select("source", "lang", "quality", i.alias("i")).groupBy("source", "lang").agg(F.coalesce(F.min(F.when(F.col("quality") == 0, F.col("i"))), F.lit(0)).alias("r"))
    return first.groupBy("source").agg(F.round(M.top_k_accuracy(F.col("r"), 2), 9).alias("top2"))


@query(f"SELECT a.conv_id, round(avg(levenshtein({_ASCII.format('a.text')}, {_ASCII.format('b.text')})), 6) AS mean FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY 1")
def self_edit_distance(t):
    rows = t.conversations.withColumn("x", _ascii("text"))
    return summary.self_pairs(rows, "conv_id", "turn", "x", lambda a, b: F.levenshtein(a, b)).select("conv_id", F.round("mean", 6).alias("mean"))


@query(_PAIRS + f", v AS (SELECT item_id, rank, {_MATCH.replace('100', '100.0')} + least(len(p), 50) AS x FROM p) SELECT item_id, max(x) FILTER (rank = 1)::DOUBLE AS first, max(x)::DOUBLE AS most, min(x)::DOUBLE AS least, round(avg(x), 6)::DOUBLE AS mean, round(sum(x * rank) / sum(rank), 6)::DOUBLE AS weighted FROM v GROUP BY 1")
def weighted_average_topk(t):
    x = (M.exact_match(F.col("g"), F.col("p")) + F.least(F.size("p"), F.lit(50))).cast("double")
    per = _ranked(t).select("item_id", "rank", x.alias("x")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("r"))
    s = M.top_k_summary(F.col("r.x"), F.col("r.rank").cast("array<double>"))
    return per.select("item_id", s[""].alias("first"), s["-max"].alias("most"), s["-min"].alias("least"), F.round(s["-avg"], 6).alias("mean"), F.round(s["-wavg"], 6).alias("weighted"))


# summaries


@query("WITH e AS (SELECT event_type, round(value)::DOUBLE AS v FROM events), m AS (SELECT event_type, v FROM (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, v) AS r FROM e GROUP BY 1, 2) WHERE r = 1) SELECT e.event_type, round(avg(e.v), 6) AS \"AVG\", sum(e.v) AS \"SUM\", max(e.v) AS \"MAX\", min(e.v) AS \"MIN\", median(e.v) AS \"MEDIAN\", round(stddev_pop(e.v), 6) AS \"STDEV\", any_value(m.v) AS \"MODE\", count(*) AS \"CNT\" FROM e JOIN m USING (event_type) GROUP BY 1")
def metric_summary_rich(t):
    got = summary.rich(t.events.select("event_type", F.round("value").alias("v")), ["event_type"], "v")
    return got.withColumns({c: F.round(c, 6) for c in ("AVG", "STDEV")})


@query("SELECT k AS metric, round(avg(v), 6) AS mean FROM (SELECT 'quality' AS k, quality::DOUBLE AS v FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels WHERE quality = 1) GROUP BY 1")
def metric_means(t):
    some = F.when(F.col("quality") == 1, F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"))).otherwise(F.create_map(F.lit("quality"), F.col("quality").cast("double")))
    return summary.means(t.labels.select(some.alias("metrics"))).select("metric", F.round("mean", 6).alias("mean"))


@query("SELECT o_orderstatus, count(*) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS q2, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS max FROM orders GROUP BY 1")
def describe(t):
    got = summary.described(t.orders, "o_totalprice", ["o_orderstatus"])
    return got.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q1", "q2", "q3")})


@query(f"SELECT conv_id, turn, len(w)::INT AS n, len(list_distinct(w))::INT AS n_distinct, len(list_intersect(list_distinct(w), r))::INT AS common, CASE WHEN len(w) = 0 THEN 'NaN'::DOUBLE ELSE round(len(list_intersect(list_distinct(w), r)) / len(list_distinct(w)), 9) END AS share FROM (SELECT a.conv_id, a.turn, regexp_extract_all(a.text, '\\p{{L}}+') AS w, regexp_extract_all(b.text, '\\p{{L}}+') AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 0)")
def overlap_features(t):
    first = t.conversations.where("turn = 0").select("conv_id", words(F.col("text")).alias("r"))
    rows = summary.overlap_features(t.conversations.select("conv_id", "turn", words(F.col("text")).alias("w")).join(first, "conv_id"), "w", ["r"])
    return rows.select("conv_id", "turn", F.col("st_w").alias("n"), F.col("stu_w").alias("n_distinct"), F.col("o_w_r").alias("common"), F.round("fo_w_r", 9).alias("share"))


@query("SELECT event_type, token, n, rank FROM (SELECT event_type, token, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first DESC, token DESC)::INT AS rank FROM (SELECT event_type, props AS token, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)) WHERE rank <= 8")
def vocab_topk(t):
    return summary.vocabulary_top(t.events, "event_type", "props", "event_id", 8).select("event_type", F.col("props").alias("token"), "n", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def worst_samples(t):
    return summary.lowest(t.orders, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT user_id, event_type, count(*) AS weight FROM events GROUP BY 1, 2")
def duplicate_weights(t):
    return summary.duplicate_weights(t.events, "user_id", "event_type")


# predictions


@query("SELECT a.conv_id AS data_id, a.turn AS stmt_i, a.conv_id * 100 + a.turn AS pos, b.role FROM conversations a JOIN conversations b USING (conv_id, turn) WHERE a.turn % 2 = 1")
def subset_predictions(t):
    pos = (F.col("conv_id") * 100 + F.col("turn")).alias("pos")
    everything = t.conversations.select(F.col("conv_id").alias("data_id"), F.col("turn").alias("stmt_i"), pos, "role")
    return ranking.subset(everything.where("stmt_i % 2 = 1").select("data_id", "stmt_i", "pos"), everything).select("data_id", "stmt_i", "pos", "found.role")


@query("""WITH l AS (SELECT source, lang, list(doc_id ORDER BY doc_id) AS ids, list((quality * 100) ORDER BY doc_id) AS run, list((toxic * 100) ORDER BY doc_id) AS comp FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN list_contains(comp, 100) THEN list_position(comp, 100) - 1 WHEN list_contains(run, 100) THEN list_position(run, 100) - 1 ELSE 0 END AS k FROM l)
SELECT source, lang, k::INT AS chosen, array_to_string(list_concat([ids[k + 1]], ids[1:k], ids[k + 2:]), ',') AS ids FROM c""")
def rerank_runnable(t):
    rows = t.documents.join(t.labels, "doc_id").groupBy("source", "lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", "quality", "toxic"))).alias("x"))
    runs = rows.select("source", "lang", F.transform("x", lambda r: r["toxic"] * 100).alias("topk_runnable"), F.transform("x", lambda r: r["quality"] * 100).alias("topk_compilable"))
    got = ranking.rerank(rows.select("source", "lang", F.col("x.doc_id").alias("ids")), runs, ["source", "lang"], ["ids"])
    return got.select("source", "lang", "chosen", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def best_row_per_group(t):
    return ranking.best_row(t.lineitem, "l_orderkey", "l_extendedprice", F.struct(*FULL_KEY)).select("l_orderkey", *FULL_KEY)


@query("SELECT doc_id AS pos, (i - 1)::INT AS rank, len(list_filter(string_split(trim(x), ' '), lambda w: w <> ''))::INT AS n FROM (SELECT doc_id, unnest(string_split(t, ' <SEP> ')) AS x, generate_subscripts(string_split(t, ' <SEP> '), 1) AS i FROM (SELECT doc_id, replace(text, chr(10), ' <SEP> ') AS t FROM documents))")
def beam_parse(t):
    lines = t.documents.select(F.col("doc_id").alias("pos"), F.replace(F.col("text"), F.lit("\n"), F.lit(" <SEP> ")).alias("value"))
    return ranking.beams(lines).select("pos", "rank", F.size("toks").alias("n"))


@query("SELECT d.doc_id AS id, coalesce('q' || quality, lang) AS value FROM documents d LEFT JOIN labels USING (doc_id)")
def merge_prediction_parts(t):
    parts = [t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("value")), t.labels.select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), "quality").alias("value"))]
    return ranking.merged_parts(parts)


@query("SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events) WHERE rank <= 3")
def top_sequences(t):
    return ranking.top_k(t.events, "user_id", "value", "event_id", 3).select("user_id", "event_id", "rank")


# tries: host names as keys

_KEYS = "SELECT page_id, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.') AS k FROM pages"


@query(f"SELECT page_id, array_to_string(k[2:], '.') AS rest FROM ({_KEYS}) WHERE k[1] = 'm'")
def trie_subtrie(t):
    keys = t.pages.select(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.").alias("key"), F.col("page_id").alias("value"))
    return tries.subtrie(keys, ["m"]).select(F.col("value").alias("page_id"), F.array_join("key", ".").alias("rest"))


@query(f"SELECT DISTINCT array_to_string(a.k[1:i], '.') AS prefix FROM (SELECT k, unnest(range(1, len(k) + 1)) AS i FROM ({_KEYS}) WHERE page_id % 2 = 0) a WHERE array_to_string(a.k[1:i], '.') IN (SELECT array_to_string(k[1:i], '.') FROM (SELECT k, unnest(range(1, len(k) + 1)) AS i FROM ({_KEYS}) WHERE page_id % 2 = 1))")
def trie_overlap(t):
    keys = t.pages.select(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.").alias("key"), F.col("page_id").alias("value"))
    return tries.overlap(keys.where("value % 2 = 0"), keys.where("value % 2 = 1")).select(F.array_join("prefix", ".").alias("prefix"))


# more of the inventory


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= CASE c_mktsegment WHEN 'BUILDING' THEN 8 WHEN 'MACHINERY' THEN 3 ELSE 1000000000 END")
def split_limits(t):
    return sampling.limited(t.customer, "c_mktsegment", ["c_custkey"], {"BUILDING": 8, "MACHINERY": 3}).select("c_mktsegment", "c_custkey")


@query("SELECT p_partkey, p_size AS first, CASE WHEN p_size % 2 = 0 THEN p_size + 3 ELSE p_size END AS last FROM part")
def line_ranges(t):
    text = F.when(F.col("p_size") % 2 == 0, F.concat_ws("-", "p_size", F.col("p_size") + 3)).otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", N.line_range(text).alias("r")).select("p_partkey", "r.*")


@query("WITH c AS (SELECT p_brand AS cls, 'm$' || p_size || '()V' AS sign, min(p_partkey) AS mid FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), l AS (SELECT cls, min(mid) AS mid FROM c GROUP BY 1) SELECT p_partkey, coalesce(c.mid, l.mid) AS mid FROM part LEFT JOIN c ON c.cls = p_brand AND c.sign = 'm$' || p_size || '()V' LEFT JOIN l ON l.cls = p_brand")
def signature_join(t):
    sign = F.concat(F.lit("m$"), "p_size", F.lit("()V"))
    rows = t.part.select("p_partkey", F.col("p_brand").alias("cls"), sign.alias("sign"))
    compiled = rows.where("p_partkey % 2 = 0").groupBy("cls", "sign").agg(F.min("p_partkey").alias("mid"))
    return resolve.by_signature(rows, compiled).select("p_partkey", "mid")


@query(f"SELECT conv_id, turn, (len(w) + 3)::INT AS size, CASE WHEN len(w) > 0 THEN 3 ELSE 2 END::INT AS height, role || ' ' || array_to_string(w, ' ') AS toks, (len(w) + 1)::INT AS last_end FROM (SELECT conv_id, turn, role, {_W} AS w FROM conversations) WHERE len(w) > 0")
def tree_features(t):
    w = words(F.col("text"))
    leaf = lambda x: F.concat(F.lit('["Word:id","2","'), x, F.lit('"]'))
    tree = F.concat(F.lit('["Turn","1-2",["Role:kw","1","'), F.col("role"), F.lit('"],["BlockStmt","2",'), F.array_join(F.transform(w, leaf), ","), F.lit("]]"))
    n = t.conversations.where(F.size(w) > 0).select("conv_id", "turn", trees.parse_tree(tree).alias("n"))
    return n.select("conv_id", "turn", trees.tree_size(F.col("n")).alias("size"), trees.tree_height(F.col("n")).alias("height"), T.joined(trees.tree_tokens(F.col("n"))).alias("toks"), trees.tree_size(trees.body(F.col("n"))).alias("last_end"))


@query(f"SELECT conv_id, turn, list_sum(list_transform(w, lambda x: ceil(length(x) / 3.0)))::INT AS subtokens, len(w)::INT AS tokens FROM (SELECT conv_id, turn, {_W} AS w FROM conversations) WHERE len(w) > 0")
def offset_maps(t):
    w = words(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", F.transform(w, lambda x: F.regexp_extract_all(x, F.lit("(.{1,3})"), F.lit(1))).alias("p")).where("size(p) > 0")
    o = T.offsets(F.col("p"))
    return rows.select("conv_id", "turn", F.element_at(o, -1)["end"].alias("subtokens"), (F.array_max(T.token_of_subtoken(F.col("p"))) + 1).alias("tokens"))


@query(f"SELECT conv_id, turn, array_to_string(list_append(w[2:], '_'), ' ') AS rolled FROM (SELECT conv_id, turn, {_W} AS w FROM conversations) WHERE len(w) > 0")
def roll_left(t):
    w = words(F.col("text"))
    return t.conversations.where(F.size(w) > 0).select("conv_id", "turn", T.joined(T.roll_left(w, F.lit("_"))).alias("rolled"))


@query("SELECT r_name AS model, n_nationkey AS trial FROM region CROSS JOIN nation WHERE r_name NOT IN ('ASIA') AND n_nationkey < 5")
def model_trials(t):
    models = t.region.select(F.col("r_name").alias("model"), F.array(F.when(F.col("r_name") == "ASIA", "assert").otherwise("x"), F.lit("x")).alias("tags"))
    chosen = filters.selected_models(models, ["x"], models.where("false"))
    # a few models by a few trials
    return chosen.select("model").crossJoin(t.nation.where("n_nationkey < 5").select(F.col("n_nationkey").alias("trial")))


@query("SELECT conv_id, turn, role NOT IN (SELECT b.role FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn) AS fresh FROM conversations a")
def unseen_values(t):
    rows = t.conversations.select("conv_id", "turn", F.array("role").alias("lits"), F.array("role").alias("vals"))
    return windows.unseen_literals(rows, ["conv_id"], ["turn"], "lits", "vals").select("conv_id", "turn", (F.size("nontrivial") > 0).alias("fresh"))


@query(f"SELECT a.page_id AS query_id, b.page_id AS hit FROM ({_KEYS}) a JOIN ({_KEYS}) b ON b.k[1:2] = a.k[1:2] AND len(b.k) >= 2 WHERE len(a.k) >= 2")
def trie_prefix_join(t):
    keys = t.pages.select(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.").alias("key"), F.col("page_id").alias("value")).where("size(key) >= 2")
    asked = keys.select(F.slice("key", 1, 2).alias("query"), F.col("value").alias("query_id"))
    return tries.prefix_join(asked, keys).select("query_id", F.col("value").alias("hit"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the')))::BIGINT AS n FROM documents")
def count_marked_lines(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(F.col("line").contains("the")).alias("n"))


@query("SELECT event_id, event_type AS name, user_id::VARCHAR AS type, props AS value FROM events")
def runtime_log_lines(t):
    line = F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), "props")
    return t.events.select("event_id", T.log_line(line).alias("r")).select("event_id", "r.*")


@query("SELECT doc_id, CASE WHEN quality IS NULL AND toxic = 0 THEN 'NaN'::DOUBLE WHEN quality IS NULL THEN 100.0 * toxic WHEN toxic = 1 THEN round((0.25 * quality + 0.75 * 100) / 1.0, 9) ELSE 1.0 * quality END::DOUBLE AS score FROM (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN quality END AS quality, toxic FROM labels)")
def combined_score(t):
    rows = t.labels
    q = F.when(F.col("doc_id") % 5 > 0, F.col("quality").cast("double"))
    x = F.when(F.col("toxic") == 1, 100.0).otherwise(float("nan"))
    return rows.select("doc_id", F.round(M.code_bleu([q, x], (0.25, 0.75)), 9).alias("score"))


@query(_PAIRS + f" SELECT round(avg(first), 6) AS xmatch, round(avg(top3), 6) AS xmatch_top3, round(avg(acc), 6) AS tok_acc FROM (SELECT item_id, max({_MATCH}) FILTER (rank = 1) AS first, max({_MATCH}) FILTER (rank <= 3) AS top3, max(CASE WHEN least(len(g), len(p)) = 0 THEN 0 ELSE 100.0::DOUBLE * len(list_filter(range(1, least(len(g), len(p)) + 1), lambda i: g[i] = p[i])) / least(len(g), len(p)) END) FILTER (rank = 1) AS acc FROM p GROUP BY 1)")
def evaluate_predictions(t):
    per = _ranked(t).groupBy("item_id").agg(F.first("g").alias("gold"), F.array_sort(F.collect_list(F.struct("rank", "p"))).alias("x")).select("item_id", "gold", F.col("x.p").alias("topk"))
    m = stages.evaluate(per, names=("xmatch", "tok-acc")).select("metrics")
    got = summary.means(m).groupBy().pivot("metric", ["xmatch", "xmatch-top3", "tok-acc"]).agg(F.round(F.first("mean"), 6))
    return got.toDF("xmatch", "xmatch_top3", "tok_acc")


@query("WITH c AS (SELECT conv_id, min(turn) AS i FROM conversations WHERE role = 'assistant' GROUP BY 1), r AS (SELECT conv_id, i FROM c WHERE conv_id % 2 = 0 AND i >= 1) SELECT r.conv_id AS id, i AS stmt_i, m.text AS gold, i AS n_before FROM r JOIN conversations m ON m.conv_id = r.conv_id AND m.turn = r.i")
def evaluation_set(t):
    per = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    tests = per.select("id", (F.col("id") % 2).alias("proj_name"), F.transform("x", lambda r: F.array(F.when(r["role"] == "assistant", F.lit("assertThat")).otherwise(r["role"]), r["text"])).alias("test_stmt_toks"))
    repos = t.rows([(0, "val")], "proj_name long, sources string")
    got = stages.eval_setup(tests, repos, None, first_assertion=True, min_stmt=1)
    return got.select("id", F.col("stmt_i").cast("long").alias("stmt_i"), F.get("gold_stmts", 1).alias("gold"), F.size("test_stmt_toks").cast("long").alias("n_before"))


def _statements(t) -> DataFrame:
    """(c_custkey, g, p): made statements, of which every third is another."""
    g = F.format_string("int x%d = f(a, b + %d); y = x%d; if (y > 0) { return y; }", F.col("c_custkey"), F.col("c_nationkey"), F.col("c_custkey"))
    return t.customer.select("c_custkey", g.alias("g"), F.when(F.col("c_custkey") % 3 == 0, F.lit("y = f(a); while (y) y = 0;")).otherwise(F.replace(g, F.lit("b"), F.lit("c"))).alias("p"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 100.0 ELSE 0.0 END::DOUBLE AS syntax FROM customer")
def code_match(t):
    g = F.format_string("int x%d = f(a);", F.col("c_custkey"))
    # the same, the same with other names, and nothing in common
    p = F.when(F.col("c_custkey") % 3 == 0, g).when(F.col("c_custkey") % 3 == 1, F.lit("int z = f(b);")).otherwise(F.lit(""))
    rows = t.customer.select("c_custkey", g.alias("g"), p.alias("p"))
    return rows.select("c_custkey", C.score(C.syntax_match("g", "p")).alias("syntax"))


@query()
def code_match_corpus(t):
    rows = _statements(t).select(C.syntax_match("g", "p").alias("s"), C.data_flow_match("g", "p").alias("d"), M.bleu(F.split("g", " "), F.split("p", " "), 1).alias("b"), M.weighted_ngram(F.split("g", " "), F.split("p", " ")).alias("w"))
    sums = rows.agg(F.avg("b").alias("b"), F.avg("w").alias("w"), *(F.struct(F.sum(f"{c}.matched").alias("matched"), F.sum(f"{c}.total").alias("total")).alias(c) for c in "sd"))
    return sums.select(F.round(M.code_bleu([F.col("b"), F.col("w"), C.score(F.col("s")), C.score(F.col("d"))]), 6).alias("code_bleu"))


@query("SELECT page_id, 'int a b;' || chr(10) || 's = \"// ' || url || ' /* */\";  ' AS code FROM pages")
def comments_removed(t):
    code = F.concat(F.lit("int a/* "), F.replace("html", F.lit("*/"), F.lit("")), F.lit("*/b;\n \ns = \"// "), "url", F.lit(" /* */\"; // "), F.replace("html", F.lit("\n"), F.lit("")), F.lit("\n"))
    return t.pages.select("page_id", T.remove_comments(code).alias("code"))


@query("SELECT c_custkey, 'POP (I[Lx/' || replace(c_mktsegment, ' ', '_') || ';)V' AS toks, 9::INT AS n FROM customer")
def descriptors_recovered(t):
    tok = F.concat(F.lit("(I[Lx/"), F.translate("c_mktsegment", " ", "_"), F.lit(";)V"))
    broken = T.break_descriptors(F.array(F.lit("POP"), tok))
    return t.customer.select("c_custkey", T.joined(T.recover_descriptors(broken)).alias("toks"), F.size(broken).alias("n"))


from millrace import inventory  # noqa: E402, F401 (registers its queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, extremes and best of each metric over ranked predictions of each benchmark item."""
    rows = _ranked(Tables(spark, sf_dir))
    g, p = F.col("g"), F.col("p")
    per = rows.select("item_id", "rank", M.exact_match(g, p).cast("double").alias("xmatch"), M.token_accuracy(g, p).alias("tok_acc"), M.bleu(g, p).alias("bleu"), M.edit_distance_similarity(g, p).alias("lev_sim"))
    return per.groupBy("item_id").agg(*(f(c).alias(f"{c}_{n}") for c in ("xmatch", "tok_acc", "bleu", "lev_sim") for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))), F.count(F.lit(1)).alias("n"))
