"""Operators on small tables of program elements."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import filters, ranking, resolve, sampling, summary, trees, tries, windows
from millrace.plans import stages
from millrace.sources import exports, tables
from millrace.streaming import changes


@pytest.fixture(scope="module")
def program(spark):
    """0 Object <- 1 A <- 2 B implements 10 I (extends 11 J, abstract m; 12 K, default m)."""
    classes = spark.createDataFrame(
        [(0, None, [], "java.lang.Object", 1, "JRE"), (1, 0, [13], "p.A", 1, "APP"), (2, 1, [10], "p.B", 1, "APP"), (10, 0, [11, 12], "p.I", 0x601, "APP"), (11, None, [], "p.J", 0x601, "APP"), (12, None, [10], "p.K", 0x601, "APP"), (13, None, [], "p.L", 0x601, "APP")],
        "cid int, ext int, impl array<int>, name string, access int, scope string",
    )
    methods = spark.createDataFrame(
        [(100, 0, "hash()I", 1, "hash", True), (101, 1, "a()V", 1, "a", True), (102, 2, "b()V", 1, "b", True), (103, 11, "m()V", 0x401, "m", True), (104, 12, "m()V", 1, "m", True), (105, 12, "d()V", 1, "d", True), (106, 1, "s()V", 9, "s", True), (107, 2, "a()V", 1, "a", True), (108, 2, "assertX()V", 1, "assertX", True)],
        "mid int, cid int, namedesc string, access int, name string, has_code boolean",
    )
    return classes, methods


def test_method_lookup(spark, program):
    asked = [(2, "a()V", "INVOKEVIRTUAL", 107), (1, "a()V", "INVOKEVIRTUAL", 101), (2, "hash()I", "INVOKEVIRTUAL", 100), (2, "m()V", "INVOKEVIRTUAL", 103), (2, "d()V", "INVOKEVIRTUAL", 105), (2, "x()V", "INVOKEVIRTUAL", None), (10, "m()V", "INVOKEVIRTUAL", None), (10, "hash()I", "INVOKEINTERFACE", 100), (10, "d()V", "INVOKEINTERFACE", 105), (2, "d()V", "INVOKEINTERFACE", None), (10, "d()V", "INVOKESPECIAL", 105), (1, "s()V", "INVOKESTATIC", 106), (2, "s()V", "INVOKESTATIC", None), (1, "d()V", "INVOKEVIRTUAL", None)]
    df = spark.createDataFrame(asked, "cid int, namedesc string, op string, want int")
    got = resolve.lookup_methods(df, *program).collect()
    assert len(got) == len(asked) and [(r.cid, r.namedesc, r.op) for r in got if r.mid != r.want] == []


def test_field_lookup_and_overrides(spark, program):
    classes, methods = program
    fields = spark.createDataFrame([(1, 0, "f"), (2, 13, "f"), (3, 2, "g"), (4, 10, "h"), (5, 11, "j")], "fid int, cid int, name string")
    asked = spark.createDataFrame([(2, "f"), (2, "g"), (2, "h"), (2, "j"), (1, "g")], "cid int, name string")
    assert {(r.cid, r.name): r.fid for r in resolve.lookup_fields(asked, classes, fields).collect()} == {(2, "f"): 2, (2, "g"): 3, (2, "h"): 4, (2, "j"): None, (1, "g"): None}
    assert set(map(tuple, resolve.override_edges(classes, methods).collect())) == {(107, 101), (104, 103)}
    names = spark.createDataFrame([("p/A",), ("q/Z",)], "owner string")
    assert [tuple(r) for r in resolve.lookup_class(names, classes).collect()] == [("p/A", 1)]


def test_closures_end_on_cycles(spark):
    loop = spark.createDataFrame([(1, 2, [3]), (2, 1, []), (3, None, [3, 1])], "cid int, ext int, impl array<int>")
    assert set(map(tuple, resolve.superclasses(loop, loop).collect())) == {(1, 1, 0), (1, 2, 1), (2, 2, 0), (2, 1, 1), (3, 3, 0)}
    assert {(r.cid, r.ancestor) for r in resolve.superinterfaces(loop, loop.where("cid = 1")).collect()} == {(1, 3)}


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "src int, dst int")
    start = spark.createDataFrame([(1, 1)], "root int, node int")
    assert {(r.node, r.depth) for r in resolve.reachable(edges, start, 2).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_process_keeps_and_counts(spark, program):
    rows = [("t1", "testIt", [], "void", True), ("t2", "test_1", [], "void", True), ("t3", "testIt", ["int"], "void", True), ("t4", "testIt", [], "void", False), ("t5", "testIt", [], "void", True), ("t6", "testIt", [], "void", True)]
    tests = spark.createDataFrame(rows, "id string, name string, ptypes array<string>, rtype string, has_ast boolean").withColumns({"has_bytecode": F.lit(True), "node_types": F.array(F.lit("Block")), "mapping_error": F.lit(False), "test_stmt_toks": F.when(F.col("id") == "t6", F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("a")))), "test_sign_toks": F.array(F.lit("s")), "focalm_toks": F.array(F.lit("f")), "has_control_flow": F.lit(False), "insn_toks": F.array(F.lit("POP"))})
    calls = spark.createDataFrame([(t, i, "p/B", n, "INVOKEVIRTUAL") for t in ("t1", "t2", "t3", "t4", "t6") for i, n in enumerate(("a()V", "b()V", "assertX()V", "a()V"))], "id string, i int, owner string, namedesc string, op string")
    kept, counters = stages.process(tests, calls, *program)
    assert [(r.id, r.focal_mid) for r in kept.collect()] == [("t1", 102)]
    assert {r.reason: r.n for r in counters.collect() if r.n} == {"badly_named": 1, "has_parameters": 1, "no_code": 1, "no_focal_method": 1, "too_few_stmts": 1}
    assert counters.count() == 15


def test_eval_setup(spark):
    tests = spark.createDataFrame([(f"csn-{k}", f"p{k % 2}", [["a"], ["assertTrue", "("], ["fail"]]) for k in range(12)], "id string, proj_name string, test_stmt_toks array<array<string>>")
    repos = spark.createDataFrame([("p0", "val"), ("p9", "test")], "proj_name string, sources string")
    got = stages.eval_setup(tests, repos, 5, first_assertion=True).collect()
    assert len(got) == 5 and {(r.proj_name, r.stmt_i, tuple(r.gold_stmts), len(r.test_stmt_toks)) for r in got} == {("p0", 1, ("assertTrue", "("), 1)}
    assert sampling.places(tests, first_assertion=True, min_stmt=2).count() == 0
    assert sampling.validation_rows(tests).count() == 36 and sampling.training_rows(tests).count() == 12
    assert stages.enrichment_order(["fields_set_notset", "types_absent"]) == ["setup_teardown", "fields_set_notset", "types_local", "types_absent"]


def test_evaluate_and_rerank(spark):
    preds = spark.createDataFrame([(0, ["x", "y"], [["x"], ["x", "y"]]), (1, ["z"], [["q"], ["z"]])], "id int, gold array<string>, topk array<array<string>>")
    runs = spark.createDataFrame([(0, [0, 100], [100, 100])], "id int, topk_runnable array<int>, topk_compilable array<int>")
    best, means = stages.rerank_and_summarize(preds, runs, ["id"])
    got = {r.id: (r.topk, r.metrics["xmatch"], r.metrics["xmatch-top3"]) for r in best.collect()}
    assert got == {0: ([["x", "y"], ["x"]], 100.0, 100.0), 1: ([["q"], ["z"]], 0.0, 100.0)}
    assert {r.metric: r["mean"] for r in means.collect()}["xmatch"] == 50
    with pytest.raises(Exception, match="no prediction"):
        to = spark.createDataFrame([("a", 1, 0)], "data_id string, stmt_i int, pos int")
        ranking.subset(to, to.withColumn("pos", F.lit(5)).where("stmt_i = 2")).collect()
    assert ranking.ids_complete(preds).head().complete and not ranking.ids_complete(preds.where("id = 1")).head().complete


def test_trees(spark):
    tree = ["Method", "1-9", ["Mod:kw", "1", "public"], ["Block", "2-3", ["Lit:str", "2", '"a"']], ["BlockStmt", "4-9", ["Call", "5", ["Name:id", "5", "f"], ["StringLiteralExpr:str", "5", '"x"']]]]
    df = spark.createDataFrame([(json.dumps(tree),), (None,)], "t string").select(trees.parse_tree("t").alias("n"))
    n = F.col("n")
    r = df.where("n is not null").select(
        trees.tree_tokens(n).alias("toks"), trees.tree_height(n).alias("h"), trees.tree_size(n).alias("size"), F.transform(trees.breadth_first(n), lambda x: x["pos"]).alias("bfs"), F.transform(trees.post_order(n), lambda x: x["pos"]).alias("post"),
        trees.tree_tokens(trees.body(n)).alias("body"), trees.tree_tokens(trees.mask_literals(n)).alias("masked"), F.transform(trees.without_subtrees(n, lambda x: x["ast_type"] == "Call"), lambda x: x["pos"]).alias("cut"), F.transform(trees.signature(n), lambda x: x["pos"]).alias("sign"), trees.has_type(n, "Call").alias("has"),
    ).head()
    assert r.toks == ["public", '"a"', "f", '"x"'] and (r.h, r["size"], r.has) == (4, 8, True)
    assert r.bfs == [0, 1, 2, 4, 3, 5, 6, 7] and r.post == [1, 3, 2, 6, 7, 5, 4, 0]
    assert r.body == ["f", '"x"'] and r.masked[-1] == "STR" and r.cut == [0, 1, 2, 3, 4, 5] and r.sign == [1, 2, 3]
    assert spark.range(1).select(trees.mask_string_constants(F.array(*map(F.lit, ["LDC", "String", "x", "POP"]))).alias("v")).head().v == ["LDC", "String", "STR", "POP"]


def test_tries(spark):
    t = spark.createDataFrame([(["a", "b"], 1), (["a", "c", "d"], 2), (["e"], 3)], "key array<string>, value int")
    assert {r.value for r in tries.with_prefix(t, ["a"]).collect()} == {1, 2}
    q = spark.createDataFrame([(["a"],), (["a", "c"],), (["z"],)], "query array<string>")
    assert sorted((tuple(r["query"]), r.value) for r in tries.prefix_join(q, t).collect()) == [(("a",), 1), (("a",), 2), (("a", "c"), 2)]
    new = tries.updated(t, spark.createDataFrame([(["e"], 9)], "key array<string>, value int"))
    assert {r.value for r in new.collect()} == {1, 2, 9} and tries.removed(new, q.select(F.array(F.lit("e")).alias("key"))).count() == 2
    assert {r.value for r in tries.within_set(t, F.array(F.lit("a"), F.lit("b"), F.lit("e"))).collect()} == {1, 3}


def test_renumbered_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = [r.new_id for r in windows.renumbered(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1000)) and windows.renumbered(df.limit(0), ["k"]).count() == 0


def test_summaries(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in summary.rich(df, ["g"], "v").collect()}
    assert (got["a"].AVG, got["a"].SUM, got["a"].MEDIAN, got["a"].MODE, got["a"].CNT) == (2, 10, 2, 1, 5)
    assert got["b"].CNT == 0 and got["b"].AVG != got["b"].AVG


def test_filters_helpers(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(10)], "g int, k int")
    assert sorted((r.g, r.k) for r in filters.size_between(df, "g", 4, 2, ["k"]).collect()) == [(0, 0), (0, 3)]
    assert {r.k for r in filters.last_wins(df, ["g"], "k").collect()} == {9, 7, 8}


def test_unseen_literals_and_next_op(spark):
    df = spark.createDataFrame([(0, ["1"], ["1", "2"], "A"), (1, ["2"], ["1", "3"], "LABEL"), (2, [], ["2", "4"], "B")], "i int, lits array<string>, vals array<string>, op string").withColumn("t", F.lit(0))
    assert [r.nontrivial for r in windows.unseen_literals(df, ["t"], ["i"], "lits", "vals").orderBy("i").collect()] == [["1", "2"], ["3"], ["4"]]
    assert [r.next_op for r in windows.next_op(df, ["t"], ["i"], "op").orderBy("i").collect()] == ["B", "B", "END"]


def test_sources(spark, tmp_path):
    ids = "\n".join(json.dumps(f"csn-{k}") for k in range(2000)) + "\n"
    toks = "\n".join(json.dumps([str(k), "x"]) for k in range(2000)) + "\n"
    (tmp_path / "id.jsonl").write_text(ids)
    (tmp_path / "toks.jsonl").write_text(toks)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = tables.read_column_files(spark, str(tmp_path), {"id": "string", "toks": "array<string>"})
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2000 and all(r.id == f"csn-{r.toks[0]}" for r in rows) and sorted(r.pos for r in rows) == list(range(2000))
    (tmp_path / "joint.cg.json").write_text(json.dumps({"edges": {"1": [["2", "C"], ["3", "O"]]}}))
    assert sorted(map(tuple, tables.read_call_graph(spark, str(tmp_path)).collect())) == [(1, 2, "C"), (1, 3, "O")]
    (tmp_path / "joint.class.json").write_text(json.dumps([{"id": 5, "access": 1, "scope": "APP", "ext": -1, "impl": [], "name": "p.A", "fields": [], "methods": [7]}]))
    own = tables.read_project(spark, str(tmp_path), "proj")
    assert [(r.id, r.methods, r.proj) for r in own.collect()] == [(5, [7], "proj")] and tables.delta(own, 6).count() == 0
    for name, lines in (("val", "a/b\nc/d\n"), ("test", "c/d\n")):
        (tmp_path / f"{name}.txt").write_text(lines)
    assert sorted(map(tuple, tables.read_repositories(spark, [f"{tmp_path}/val.txt", f"{tmp_path}/test.txt"]).collect())) == [("a/b", "val"), ("c/d", "test")]
    (tmp_path / "preds.csv").write_text('idxs,logit_1,pred_assertion\n0,0.5,"a, ""q"""\n0,0.9,b\n1,0.1,c\n')
    assert sorted((r.idxs, r.pred_assertion) for r in tables.read_scored_csv(spark, f"{tmp_path}/preds.csv").collect()) == [(0, "b"), (1, "c")]
    df = spark.createDataFrame([("1", 'say "x"')], "id string, text string")
    tables.write_csv(df, f"{tmp_path}/out.csv")
    parts = [p.read_text().split("\n", 1) for p in (tmp_path / "out.csv").iterdir() if p.suffix == ".csv"]
    assert {p[0] for p in parts} == {'"id","text"'} and "".join(p[1] for p in parts) == '"1","say ""x"""\n'
    tables.write_columns(df, f"{tmp_path}/data")
    tables.write_columns(df, f"{tmp_path}/data", append=True)
    back = tables.read_columns(spark, f"{tmp_path}/data", only=["id", "absent"])
    assert back.columns == ["id"] and back.count() == 2 and not tables.keys_unique(back)
    (tmp_path / "typevalue").write_text("intVar int 100\ns java.lang.String a b\n")
    assert sorted(map(tuple, tables.read_runtime_log(spark, f"{tmp_path}/typevalue").collect())) == [("intVar", "int", "100"), ("s", "java.lang.String", "a b")]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(["t", "("], [["a"], ["b"], ["c"]], ["f"])], "test_sign_toks array<string>, test_stmt_toks array<array<string>>, focalm_toks array<string>")
    pairs = exports.method_and_assertion(df, F.lit(2), F.get("test_stmt_toks", 2))
    assert tuple(pairs.head()) == ("t ( { a b <AssertPlaceHolder> } f", "c")
    assert tuple(exports.assertion_samples(df, F.lit(0), F.col("focalm_toks")).head()) == ("f", 't ( { "<AssertPlaceHolder>" ; }', "f")
    exports.write_pairs(pairs, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/assertLines").head().value == "c"


def test_streamed_changes_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 20").withColumn("value", F.floor(F.col("value") / 50).cast("double")).withColumn("ts", F.col("ts").cast("timestamp"))
    events.where("user_id < 6").select("user_id", "event_type", "ts", "event_id", "value").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = changes.append_batches(changes.changed_values(stream), f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.event_id for r in windows.changes(events.where("user_id < 6"), ["user_id", "event_type"], ["ts", "event_id"], "value").collect()}
    assert got == want


def test_streamed_sessions(spark, tmp_path):
    rows = [("s", 0, "start", ""), ("s", 1, "try", "a"), ("s", 2, "submit", "b"), ("s", 3, "try", "c"), ("s", 4, "end", ""), ("s", 5, "try", "d")]
    spark.createDataFrame(rows, "session string, seq long, command string, argument string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, seq long, command string, argument string").parquet(f"{tmp_path}/in")
    q = changes.append_batches(changes.sessions(stream), f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.seq: (r.state, r.ok) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: ("", True), 1: ("a", True), 2: ("b", True), 3: ("b c", True), 4: ("b", True), 5: (None, False)}
