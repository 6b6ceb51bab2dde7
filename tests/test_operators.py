"""Replay, resolution, traversal, evidence and listing operators on small inputs and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from rootweave.functions import text as T
from rootweave.operators import evidence as E
from rootweave.operators import graph as G
from rootweave.operators import listing as L
from rootweave.operators import resolve as R
from rootweave.operators import trace as X
from rootweave.operators import traverse as V


def _events(spark, rows, span=4):
    df = spark.createDataFrame([("r", i, t, f, "m.py", None) for i, (t, f) in enumerate(rows)], "run_id string, seq long, type string, function string, filename string, exception string")
    return X.bucketed(df, span)


def _steps(df):
    return [r["stack_depth"] for r in X.replay_steps(df).orderBy("seq").collect()]


def test_depths_of_the_published_cases(spark):
    rows = [("call", "main"), ("call", "helper"), ("line", "helper"), ("return", "helper"), ("return", "main")]
    assert _steps(_events(spark, rows)) == [0, 1, 2, 2, 1]
    assert X.max_stack_depth(_events(spark, rows)).first()["max_depth"] == 2
    assert _steps(_events(spark, [("return", "main"), ("line", "module")])) == [0, 0]


def test_depths_links_and_sequences_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["call", "return", "line", "exception"]), f"f{rng.randrange(3)}") for _ in range(700)]
    depth, expected = 0, []
    for kind, _ in rows:
        expected.append(depth)
        depth = max(0, depth + {"call": 1, "return": -1}.get(kind, 0))
    events = _events(spark, rows, 16)
    assert _steps(events) == expected
    ends = X.replay_steps(events).filter("index IN (0, 699)").orderBy("index").collect()
    assert [(r["previous_index"], r["next_index"], r["position"], r["total"]) for r in ends] == [(None, 1, 1, 700), (698, None, 700, 700)]
    calls = X.matching(events, "call").withColumn("node_id", F.col("function"))
    names = [f for kind, f in rows if kind == "call"]
    kept = [f for i, f in enumerate(names) if i == 0 or names[i - 1] != f]
    assert [r["node_id"] for r in X.execution_sequence(calls).orderBy("seq").collect()] == kept
    assert {(r["source"], r["target"]) for r in X.executes_after(calls).collect()} == set(zip(kept, kept[1:], strict=False))


def test_paging_and_filters(spark):
    events = _events(spark, [("call", n) for n in ("alpha", "beta", "alphabet")])
    assert X.matching(events, "call", "alpha").count() == 2
    page = X.page(_events(spark, [("call", "f")] * 10), ["seq"], 2, 3).orderBy("seq").collect()
    assert [r["seq"] for r in page] == [2, 3, 4] and page[0]["total_matched"] == 10
    with pytest.raises(ValueError):
        X.page(events, ["seq"], -1, 3)


def test_exception_text(spark):
    df = spark.createDataFrame([("ValueError: kaboom",), ("Boom",)], "e string")
    assert [tuple(r) for r in df.select(T.exception_type(F.col("e")), T.exception_message(F.col("e"))).collect()] == [("ValueError", "kaboom"), ("Boom", "Boom")]


def test_path_functions(spark):
    df = spark.createDataFrame([("C:\\w\\a.CPP ", "w/a.cpp", "x/a.cpp")], "a string, b string, c string")
    row = df.select(T.detect_language(F.col("a")), T.basename(F.col("a")), T.same_source(F.lit("C:\\w\\a.cpp"), F.col("b")), T.same_source(F.col("b"), F.col("c")), T.safe_int(F.lit(" 7 ")), T.safe_int(F.lit("x")), T.id_name(F.lit("a::b::c")), T.truncated(F.lit("abcd"), 2)).first()
    assert tuple(row) == ("C++", "a.CPP ", True, False, 7, None, "c", "ab\n... [truncated]")


def test_calls_fall_through_ambiguity(spark):
    functions = spark.createDataFrame([("a", "f", "a::f"), ("b", "f", "b::f"), ("b", "g", "b::g"), ("c", "h", "c::h1"), ("c", "h", "c::h2"), ("d", "h", "d::h")], "module string, name string, id string")
    calls = spark.createDataFrame([("a", "f"), ("a", "self.f"), ("a", "g"), ("a", "self.g"), ("c", "h"), ("c", "f"), ("a", "h"), ("a", "len")], "module string, call string")
    got = {(r["module"], r["call"]): r["target"] for r in R.resolve_calls(calls, functions).collect()}
    assert got == {("a", "f"): "a::f", ("a", "self.f"): "a::f", ("a", "g"): "b::g", ("a", "self.g"): "external::self.g", ("c", "h"): "d::h", ("c", "f"): "external::f", ("a", "h"): "external::h", ("a", "len"): "external::len"}


def test_imports_take_the_longest_prefix(spark):
    modules = spark.createDataFrame([("pkg.py",), ("pkg/sub.py",), ("pkg/sub/mod.py",), ("mylib.h",)], "path string")
    imports = spark.createDataFrame([("m.py", "pkg.sub.mod"), ("m.py", "pkg.sub.other"), ("m.py", "requests"), ("m.c", "mylib.h"), ("m.c", "stdio.h")], "path string, module string")
    got = {r["module"]: r["target"] for r in R.resolve_imports(imports, modules).collect()}
    assert got == {"pkg.sub.mod": "pkg/sub/mod.py", "pkg.sub.other": "pkg/sub.py", "requests": None, "mylib.h": "mylib.h", "stdio.h": None}
    modules = spark.createDataFrame([("impl.c",), ("dir/part.h",), ("dir.py",), ("x/y.py",)], "path string")
    imports = spark.createDataFrame([("m.c", "impl.c"), ("m.c", "dir/part.h"), ("m.c", "dir/none.h"), ("m.py", "x.y.z")], "path string, module string")
    got = {r["module"]: r["target"] for r in R.resolve_imports(imports, modules).collect()}
    assert got == {"impl.c": "impl.c", "dir/part.h": "dir/part.h", "dir/none.h": None, "x.y.z": "x/y.py"}


def test_runtime_links_need_one_match(spark):
    functions = spark.createDataFrame([("src/a.py::C.run", "C.run", "src/a.py"), ("x/b.py::go", "go", "x/b.py"), ("y/b.py::go", "go", "y/b.py")], "id string, name string, file string")
    refs = spark.createDataFrame([("Python", "/r/src/a.py", "run"), ("Python", "b.py", "go"), ("Python", "/r/x/b.py", "go")], "language string, filename string, function string")
    got = {r["filename"]: r["node_id"] for r in R.link_runtime(refs, functions).collect()}
    assert got == {"/r/src/a.py": "src/a.py::C.run", "b.py": "runtime::Python::b.py::go", "/r/x/b.py": "x/b.py::go"}


def test_traversals_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("f", "e"), ("g", "f")], "source string, target string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r["node"], r["depth"]) for r in V.reverse_depths(edges, start).collect()} == {("c", 1), ("d", 1), ("b", 2), ("e", 2), ("f", 3)}
    assert {r["node"] for r in V.reachable(edges, start).collect()} == {"a", "b", "c"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "source long, target long")
    assert V.reachable(chain, spark.createDataFrame([(0,)], "id long")).count() == 21  # more rounds than tables are kept apart


def test_order_of_functions_and_own_frames(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["call", "line"]), f"f{rng.randrange(3)}") for _ in range(60)]
    got = X.function_order(_events(spark, rows, 8)).orderBy("place").collect()
    assert [r["function"] for r in got] == [f for kind, f in rows if kind == "call"] and [r["place"] for r in got] == list(range(len(got)))
    df = spark.createDataFrame([([("h", 1), ("h", 2), ("m", 3), ("h", 4)],), ([("h", 1)],), ([("m", 1)],), ([],)], "f array<struct<file:string,line:int>>")
    assert [[x["line"] for x in r[0]] for r in df.select(X.without_leading(F.col("f"), "h")).collect()] == [[3, 4], [], [1], []]
    scores = spark.createDataFrame([("r", n, round(rng.random(), 2)) for n in range(80)], "run_id string, node long, score double")
    ranked = {r["node"]: r["rank"] for r in L.ranked(scores).collect()}
    best = sorted(scores.collect(), key=lambda r: (-r["score"], r["node"]))
    assert [ranked[r["node"]] for r in best] == list(range(1, 81))


def test_graph_first_wins_and_fusion(spark):
    nodes = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 3)], "id string, kind string, ord int")
    assert {(r["id"], r["kind"]) for r in G.distinct_nodes(nodes).collect()} == {("a", "y"), ("b", "z")}
    evidence = spark.createDataFrame([("n", "ast", "0.5"), ("n", "ast", "0.7"), ("n", "cfg", "0.7")], "node string, source string, score string").withColumn("score", F.col("score").cast("decimal(5,4)"))
    assert E.fuse(evidence).first()["score"] == 0.119
    assert E.best(evidence).first()["source"] == "ast"


def test_latest_ready_and_suites(spark):
    runs = spark.createDataFrame([("p", "a", "ready", 1, 1), ("p", "b", "ready", 1, 2), ("p", "c", "failed", 9, 3)], "project_id string, id string, status string, updated_at int, ord int")
    assert [r["id"] for r in L.latest_ready(runs).collect()] == ["b"]
    cases = spark.createDataFrame([("passed", 1.0), ("error", 1.0), ("skipped", 0.5)], "outcome string, duration_seconds double").withColumn("suite", F.lit("s"))
    row = L.suite_counts(cases, ["suite"]).first()
    assert (row["passed"], row["failed"], row["skipped"], row["total"]) == (1, 1, 1, 3)
    assert not L.suites_summary(L.suite_counts(cases, ["suite"])).first()["succeeded"]
    fine = cases.filter("outcome = 'passed'")
    assert L.suites_summary(L.suite_counts(fine, ["suite"])).first()["succeeded"]
    assert not L.suites_summary(L.suite_counts(fine.withColumn("suite_error", F.lit("no link")), ["suite"])).first()["succeeded"]
    assert not L.suites_summary(L.suite_counts(cases.limit(0), ["suite"])).first()["succeeded"]


def test_frames_of_a_traceback_are_searched_once(spark):
    from pyspark.sql import functions as F

    from rootweave.plans import project_queries as Q
    from rootweave.sources.recordings import traceback_frames

    plan = Q.own_frames(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    text = 'Traceback (most recent call last):\n\n  File "a b.py", line 3, in f g \n    File "c.py", line 4\n File "d.py", line x\n  File "e.py", line 5, in h\nE: x'
    rows = spark.createDataFrame([(text,), ("no frames",), (None,)], "t string").select(traceback_frames(F.col("t")).alias("f")).collect()
    assert [[tuple(x) for x in r["f"] or []] for r in rows] == [[("a b.py", 3, "f g"), ("c.py", 4, "<module>"), ("e.py", 5, "h")], [], []]
