"""What keeps plans bounded: doubling, stored adjacency, ranges, the ending index, and many runs at once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rootweave.operators import adjacency as A
from rootweave.operators import listing as L
from rootweave.operators import resolve as R
from rootweave.operators import trace as X
from rootweave.operators import traverse as V
from rootweave.operators.ranges import RANGE, in_ranges
from rootweave.plans import knowledge as K
from rootweave.plans import localize as Z
from rootweave.plans import project as P
from tests.test_localize import SCORES, _inputs


def _start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_a_deep_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    rounds: list[int] = []
    assert V.reachable(chain, _start(spark, 0), rounds=rounds).count() == n + 1 and len(rounds) < 25


@pytest.mark.parametrize("growth", [0.0, 100.0])
def test_doubling_equals_a_plain_search(spark, growth):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(i, i + 1) for i in range(100, 115)] + [(115, 100), (0, 100), (110, 3)]
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    seen, todo = {0, 7}, [0, 7]
    while todo:
        todo = [b for a in todo for b in after.get(a, ()) if not (b in seen or seen.add(b))]
    table = spark.createDataFrame(edges, "source long, target long").coalesce(1)
    found = V.reachable(table, _start(spark, 0, 7), patience=1, growth=growth)
    assert sorted(r["node"] for r in found.collect()) == sorted(seen)
    assert V.reachable(table.limit(0), _start(spark, 0)).count() == 1 and V.reachable(table, _start(spark)).count() == 0


def test_stored_edges_are_not_moved(spark):
    edges = spark.range(3000).select((F.col("id") % 97).alias("source"), (F.col("id") * 7 % 89).alias("target"), F.lit("calls").alias("kind"))
    stored = A.stored(edges)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("rootweave_edges")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = V.reverse_depths(stored, _start(spark, 5, 6), "calls")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") >= 3
        # between a scan of the edges and the join it feeds there is no exchange
        lines = plan.split("\n")
        for at, line in enumerate(lines):
            if "Bucketed: true" in line:
                depth = len(re.match(r"[\s:+\-|]*", line)[0])
                above = next(x for x in reversed(lines[:at]) if len(re.match(r"[\s:+\-|]*", x)[0]) < depth and re.search("Join|Exchange|Aggregate", x))
                assert "Join" in above, above
        plain = V.reverse_depths(edges, _start(spark, 5, 6), "calls")
        assert sorted(found.collect()) == sorted(plain.collect())
        by_run = V.run_depths(stored, spark.createDataFrame([("a", 5), ("a", 6), ("b", 6)], "run_id string, id long"), "calls")
        assert {(r["node"], r["depth"]) for r in by_run.filter("run_id = 'a'").collect()} == {tuple(r) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_scores_spread_over_ranges(spark):
    scores = spark.range(40_000).select(F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("run_id"), F.col("id").alias("node"), F.lit(0.01).alias("score"))
    ranges = in_ranges(scores, ["run_id", F.desc("score"), "node"], 16)
    largest = ranges.sizes().agg(F.max("n")).first()[0]
    assert largest < 3 * 40_000 / 16
    ranked = L.ranked(scores)
    wrong = ranked.filter(F.col("rank") != F.when(F.col("run_id") == "b", F.floor(F.col("node") / 100) + 1).otherwise(F.col("node") - F.floor(F.col("node") / 100)))
    assert ranked.count() == 40_000 and wrong.isEmpty()
    assert L.ranked(scores.limit(0)).isEmpty()


def test_a_far_page_reads_one_range(spark):
    rows = spark.range(1_200_000).select((F.col("id") * 7919 % 1_200_007).alias("seq"))
    order = sorted((i * 7919 % 1_200_007 for i in range(1_200_000)))
    ranges = in_ranges(rows, ["seq"], 24)
    page = ranges.page(1_000_000, 50)
    assert [r["seq"] for r in page.collect()] == order[1_000_000:1_000_050] and page.first()["total_matched"] == 1_200_000
    filters = re.search(r"PartitionFilters: \[(.*?)\], Push", page._jdf.queryExecution().executedPlan().toString())[1]
    assert RANGE in filters and " IN " not in filters  # one range
    assert [r["seq"] for r in X.page(rows, ["seq"], 1_199_990, 50).collect()] == order[1_199_990:]
    assert X.page(rows, ["seq"], 2_000_000, 5).isEmpty()


def test_files_of_one_name_do_not_meet_in_pairs(spark):
    n = 2000
    functions = spark.range(n).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("main").alias("name"), F.concat(F.lit("d"), F.col("id"), F.lit("/main.py")).alias("file"))
    refs = spark.range(n).select(F.lit("Python").alias("language"), F.concat(F.lit("/srv/d"), F.col("id"), F.lit("/main.py")).alias("filename"), F.lit("main").alias("function"))
    odd = spark.createDataFrame([("Python", "main.py", "main"), ("Python", "d7\\main.py", "main"), ("Python", None, "main"), ("Python", "/x/main.py", "main")], "language string, filename string, function string")
    assert R.ending_matches(refs.union(odd), functions).count() <= n + 2
    found = {r["filename"]: r["node_id"] for r in R.link_runtime(refs.union(odd), functions).collect()}
    assert all(found[f"/srv/d{i}/main.py"] == f"f{i}" for i in range(n))
    assert found["main.py"] == "runtime::Python::main.py::main" and found["d7\\main.py"] == "f7" and found["/x/main.py"].startswith("runtime::")


def test_many_runs_are_localised_together(spark):
    nodes, edges, run, events = _inputs(spark)
    wide = "run_id string, language string, stderr string, exception_type string, exception_message string"
    text = run.first()["stderr"]
    runs = spark.createDataFrame([("one", "Python", text, "KeyError", "'XX'"), ("two", "Python", text.rsplit("  File", 1)[0] + "E: x", "E", "x"), ("three", "Python", None, None, None)], wide)
    second = events.filter("seq < 4").withColumn("run_id", F.lit("two"))
    both = events.withColumn("run_id", F.lit("one")).unionByName(second)
    ranked, result = Z.localize_runs(nodes, A.stored(edges), runs, both, threshold="0.5")
    scores: dict[str, dict] = {}
    for r in ranked.select("run_id", "node_id", "score").collect():
        scores.setdefault(r["run_id"], {})[r["node_id"]] = r["score"]
    assert scores["one"] == {n: round(x, 4) for n, x in SCORES.items()}
    assert max(scores["two"], key=scores["two"].get) == "price.py::net" and scores["two"]["tax.py::rate"] < scores["one"]["tax.py::rate"]
    verdicts = {r["run_id"]: r for r in result.collect()}
    assert verdicts["one"]["root_cause"]["node_id"] == "tax.py::rate" and verdicts["one"]["propagation_path"] == ["checkout", "net", "rate"] and verdicts["one"]["confidence"] == 0.514
    assert verdicts["two"]["root_cause"]["node_id"] == "price.py::net" and verdicts["two"]["propagation_path"] == ["checkout", "net"]
    assert not verdicts["three"]["has_candidates"] and verdicts["three"]["propagation_path"] == [] and verdicts["three"]["confidence"] == 0.0


def test_a_result_does_not_need_every_holder_of_a_name(spark):
    """n runs whose frames hold a name of n variables: results are those of all n * n candidates, from a few a run."""
    n = 40
    nodes = [(f"f{i}.py::fn{i}", "function", f"fn{i}", f"f{i}.py", i) for i in range(n)] + [(f"f{i}.py", "module", f"f{i}.py", f"f{i}.py", None) for i in range(n)]
    nodes += [(f"f{i}.py::fn{i}::v", "variable", "v", None, None) for i in range(n)]
    nodes += [(f"f{i}.py::fn{i}:block0", "condition", "if", None, i + 1) for i in range(0, n, 3)]
    edges = [(f"f{i}.py::fn{i}", f"f{(i + 1) % n}.py::fn{(i + 1) % n}::v", "writes") for i in range(n)] + [(f"f{i}.py", f"f{i - 1}.py", "imports") for i in range(1, n, 2)]
    graph = spark.createDataFrame([(*x, False, at) for at, x in enumerate(nodes)], "id string, kind string, label string, file string, line int, runtime boolean, ord long")
    links = spark.createDataFrame(edges, "source string, target string, kind string")
    text = 'Traceback (most recent call last):\n  File "/srv/f{0}.py", line {1}, in gone\nE: x\n'
    runs = spark.createDataFrame([(f"r{i}", "Python", text.format(i, i + 2) if i % 4 else None, "E", "x") for i in range(n)], "run_id string, language string, stderr string, exception_type string, exception_message string")
    events = spark.createDataFrame([(f"r{i}", 0, "exception", "gone", f"/srv/f{i}.py", {"v": "1"}) for i in range(n)], "run_id string, seq long, type string, function string, filename string, variables map<string,string>")
    functions = graph.filter("kind = 'function'").select("id", Z.F.col("label").alias("name"), "file")
    stored = A.stored(links)
    crash = Z.kept(Z.crashes(graph, stored, runs, functions), "crash")
    own, held, named, facts, files = Z._tables(graph, stored, crash, events, functions)
    fields = ["run_id", "confidence", "summary", "root_cause", "propagation_path", "evidence_summary", "missing_sources", "location"]

    def results(rows):
        ranked = Z.rank_candidates(Z.described(rows, facts, crash, files))
        return sorted(Z.result(ranked, crash, graph, "0.2").select(*fields).collect())

    every, few = Z.candidates(own, held, named), Z.leading(own, held, named, facts, crash, files)
    assert every.count() >= n * n and few.count() <= 12 * n
    assert results(few) == results(every)


def test_a_graph_is_made_of_keys_that_were_moved_once(spark):
    """Its edges are read from steps that are written, without another pass over lines or an exchange of names, and none is doubled."""
    nodes, edges = P.crash_graph(spark, "/root/testdata/sf0.001")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not re.search(r"Join|hashpartitioning\(source#\d+, target#\d+, kind", plan)
    assert edges.count() == edges.distinct().count() > 0
    ids = nodes.select("id").distinct()
    assert edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").count() == edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").count() == 0


def test_one_run_meets_a_part_of_the_graph(spark):
    """Facts are gathered of what is wanted alone, functions by the names that are told, and small frontiers meet edges that stay in place."""
    nodes, edges = (Z.kept(x, "graph", "kind") for x in P.crash_graph(spark, "/root/testdata/sf0.001"))
    wanted = nodes.filter("kind = 'function' AND ord % 6 = 0").select(F.col("id").alias("node_id"))
    every = Z.facts_of(nodes, edges).join(wanted, "node_id", "left_semi")
    found = Z.facts_of(nodes, edges, wanted)
    assert sorted(found.collect()) == sorted(every.select(found.columns).collect()) and found.count() == wanted.count() > 0
    functions = nodes.filter("kind IN ('function', 'method')").select("id", F.col("label").alias("name"), "file")
    runs = spark.createDataFrame([('Traceback (most recent call last):\n  File "p0/m1.py", line 3, in fn1\nE: x\n',), (None,)], "stderr string")
    events = spark.createDataFrame([("fn7",), (None,), ("gone",)], "function string")
    assert sorted(r["name"] for r in Z._met(functions, runs, events).collect()) == ["C.fn7", "fn1"]
    start = functions.filter("name = 'fn1'").select(F.lit("r").alias("run_id"), "id")
    steps = V.run_depths(edges, Z.kept(start, "start"), "calls")
    back = V.reverse_depths(edges, start, "calls")
    assert sorted((r["node"], r["depth"]) for r in steps.collect()) == sorted((r["node"], r["depth"]) for r in back.collect() if r["depth"])
    assert "kind=calls" not in steps._jdf.queryExecution().executedPlan().toString()  # what is left to do reads frontiers alone


def test_a_recorded_program_is_derived_and_linked_once(spark):
    """Events are read from what is written, not from lines again, and edges of a run from linked events."""
    events, errors = P.recorded(spark, "/root/testdata/sf0.001")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (events, errors)]
    assert not [x for x in plans if "lineitem" in x or "Join" in x] and events.count() == events.distinct().count()
    assert errors.count() == events.filter("type = 'exception'").count() > 0
    columns = "id string, kind string, label string, file string"
    nodes = spark.createDataFrame([("a.py::f", "function", "f", "a.py"), ("a.py::g", "function", "g", "a.py")], columns)
    few = spark.createDataFrame([("r", "Python", at, "call", name, "/srv/a.py") for at, name in enumerate("fgh")], "run_id string, language string, seq long, type string, function string, filename string")
    _, edges = K.runtime_rows(nodes, few, None)
    assert "Generate" not in edges._jdf.queryExecution().executedPlan().toString()
    assert sorted(edges.select("source", "target").collect()) == [("a.py::f", "a.py::g"), ("a.py::g", "runtime::Python::/srv/a.py::h")]
