"""From source files and a recorded crash to the report, and the live form of replay."""

import io
import json
import zipfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from rootweave.functions import text as T
from rootweave.operators import trace as X
from rootweave.plans import facade as A
from rootweave.sources import files as S
from rootweave.streaming.replay import DEPTHS, event_stream, live_depths


def test_crash_end_to_end(spark, tmp_path):
    (tmp_path / "compute.py").write_text("def compute(x):\n    return 10 / x\n")
    (tmp_path / "main.py").write_text("from compute import compute\n\ndef main():\n    compute(0)\n\nmain()\n")
    files = A.project(spark, str(tmp_path))
    summary = A.project_summary(files).first()
    assert (summary["file_count"], summary["languages"]) == (2, ["Python"])
    registry = A.Registry(spark, str(tmp_path / "store"))
    modules = registry.run("analysis", "a1", "p", lambda: A.analysis(files))
    counts = A.analysis_summary(modules).first()
    assert counts["parsed_file_count"] == 2 and (counts["dependency_edge_count"], counts["call_edge_count"], counts["dataflow_node_count"]) == (1, 1, 4)
    with pytest.raises(ZeroDivisionError):
        registry.run("analysis", "a2", "p", lambda: 1 / 0)
    with pytest.raises(A.NotReady):
        registry.ready("a2")
    assert [r["id"] for r in registry.listed("analysis").collect()] == ["a2", "a1"]
    with pytest.raises(A.Missing):
        registry.ready("a3")
    nodes, edges = A.analysis_graph(modules, "call")
    assert ("main.py::main", "compute.py::compute") in {(r["source"], r["target"]) for r in edges.collect()}
    with pytest.raises(A.Missing):
        A.analysis_graph(modules, "other")
    events = [("call", "main", "main.py", None), ("call", "compute", "compute.py", None), ("exception", "compute", "compute.py", "ZeroDivisionError: division by zero")]
    events = spark.createDataFrame([("r", "Python", i, t, f, p, {"x": "0"}, e) for i, (t, f, p, e) in enumerate(events)], "run_id string, language string, seq long, type string, function string, filename string, variables map<string,string>, exception string")
    graph = A.knowledge("p", modules, events)
    summary = A.knowledge_summary(graph).first()
    assert summary["node_count"] == graph.nodes.count() and summary["missing_sources"] == []
    registry.run("graph", "g1", "p", lambda: {"nodes": graph.nodes, "edges": graph.edges}, write=True)
    assert registry.last("graph", "p", "nodes").count() == summary["node_count"]
    with pytest.raises(ZeroDivisionError):
        registry.run("graph", "g2", "p", lambda: {"nodes": 1 / 0}, write=True)
    with pytest.raises(A.NotReady):
        registry.last("graph", "p", "nodes")
    registry.run("graph", "g3", "p", lambda: {"nodes": graph.nodes.limit(1)}, write=True)
    assert registry.last("graph", "p", "nodes").count() == 1
    with pytest.raises(A.Missing):
        registry.last("graph", "q", "nodes")
    stderr = 'Traceback (most recent call last):\n  File "main.py", line 4, in main\n  File "compute.py", line 2, in compute\nZeroDivisionError: division by zero\n'
    run = spark.createDataFrame([("Python", stderr, "ZeroDivisionError", "division by zero")], "language string, stderr string, exception_type string, exception_message string")
    ranked, result = A.localization(graph, run, events)
    assert result.first()["propagation_path"] == ["main", "compute"]
    report = A.explanation("p", graph, result, run).first()
    assert report["error_summary"].startswith("ZeroDivisionError")


def test_replay_requests(spark):
    rows = [("r", i, t, f, "m.py", e) for i, (t, f, e) in enumerate([("call", "a", None), ("call", "b", None), ("exception", "b", "E: x"), ("return", "b", None), ("call", "b", None)])]
    events = X.bucketed(spark.createDataFrame(rows, "run_id string, seq long, type string, function string, filename string, exception string"), 2)
    summary = A.replay_summary(events).first()
    assert (summary["max_depth"], summary["first_index"], summary["last_index"], summary["total"], summary["exception_type"]) == (2, 0, 4, 5, "E")
    page = A.replay_steps(events, "call", None, 1, 5).orderBy("index").collect()
    assert [(r["index"], r["stack_depth"], r["total_matched"]) for r in page] == [(1, 1, 3), (4, 1, 3)]
    assert A.replay_step(events, 2).first()["previous_index"] == 1
    for bad in (lambda: A.replay_steps(events, limit=1001), lambda: A.replay_step(events, -1)):
        with pytest.raises(ValueError):
            bad()
    results = spark.createDataFrame([("r", "Python", "ready", None), ("r", "C", "ready", "E"), ("s", "C", "failed", None)], "run_id string, language string, status string, exception_type string")
    assert A.result_of(results, "r", "C").first()["exception_type"] == "E"
    for run, language in (("r", "Java"), ("s", "Python")):
        with pytest.raises(A.Missing):
            A.result_of(results, run, language)
    assert {(r["run_id"], r["executed_count"], r["succeeded"]) for r in A.executions(results).collect()} == {("r", 2, True), ("s", 1, False)}
    assert A.picked_run(results.withColumn("ord", F.monotonically_increasing_id())).first()["language"] == "C"
    cases = spark.createDataFrame([("Python", "passed", 1.0, None), ("C", "passed", 1.0, "did not link")], "language string, outcome string, duration_seconds double, suite_error string")
    assert not A.test_summary(cases).first()["succeeded"] and A.test_summary(cases.filter("language = 'Python'")).first()["succeeded"]


def test_archives_are_read_in_tasks(spark, tmp_path):
    for name, members in (("good", {"tree/a.py": "x = 1\n", "tree/sub/b.c": "int main;", "tree/.git/c.py": "y"}), ("bad", {"../a.py": "x"})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as archive:
            for path, text in members.items():
                archive.writestr(path, text)
    files = A.project_archive(spark, str(tmp_path / "good.zip"))
    assert {(r["path"], r["language"], r["lines"]) for r in files.collect()} == {("a.py", "Python", 1), ("sub/b.c", "C", 1)}
    parsed = A.analysis(files).select("language", "path").join(files.select("path", T.content_key(F.col("text")).alias("content_key")), "path")
    assert A.cache_counts(files, parsed.filter("path = 'a.py'")).first().asDict() == {"hits": 1, "misses": 1}
    with pytest.raises(Exception, match="outside its folder"):
        A.project_archive(spark, str(tmp_path / "bad.zip")).count()


def test_members_of_one_archive_are_unpacked_by_several_tasks(spark, tmp_path):
    texts = {f"top/m{i}.py": f"x = {i}\n" * (i * 40) for i in range(40)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for i, (name, text) in enumerate(texts.items()):
            archive.writestr(name, text, zipfile.ZIP_STORED if i % 7 == 0 else None)
        archive.writestr("top/sub/", "")
    found = S.zipped_files(spark, str(tmp_path / "a.zip"), parts=4)
    rows = found.select("path", F.col("content").cast("string").alias("text"), "size_bytes", F.spark_partition_id().alias("task")).collect()
    assert {"top/" + r["path"]: r["text"] for r in rows} == texts and all(r["size_bytes"] == len(r["text"]) for r in rows)
    assert len({r["task"] for r in rows}) == 4
    with pytest.raises(PythonException, match="too large unpacked"):
        S.zipped_files(spark, str(tmp_path / "a.zip"), max_bytes=100_000).count()
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.index(b"m9.py") + 12] ^= 255
    (tmp_path / "b.zip").write_bytes(bytes(raw))
    with pytest.raises(PythonException, match="damaged|invalid|Error"):
        S.zipped_files(spark, str(tmp_path / "b.zip")).collect()


def test_archives_reach_a_worker_one_at_a_time(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as opened:
        opened.writestr("top/a.txt", "a")
    archives = spark.range(300).select(F.concat(F.lit("z"), "id").alias("path"), F.lit(len(out.getvalue())).cast("long").alias("length"), F.lit(out.getvalue()).alias("content"))
    found = S.members_of(archives)
    assert found.count() == 300 and found.select("archive").distinct().count() == 300
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan and plan.count("MapInPandas") >= 1


def test_live_depths_keep_state_between_batches(spark, tmp_path):
    rows = [("call", 0), ("call", 1), ("return", 2), ("return", 3), ("return", 4), ("call", 5)]
    source = tmp_path / "in"
    source.mkdir()
    query = live_depths(event_stream(spark, str(source))).writeStream.format("memory").queryName("depths").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for part in (rows[:3], rows[3:]):
            (source / f"{part[0][1]}.json").write_text("".join(json.dumps({"run_id": "r", "seq": s, "type": t, "function": "f", "filename": "m.py"}) + "\n" for t, s in part))
            query.processAllAvailable()
        got = [r["stack_depth"] for r in spark.table("depths").orderBy("seq").collect()]
    finally:
        query.stop()
    assert got == [0, 1, 2, 1, 0, 0] and DEPTHS
