"""Documents in parts, and documents read in pieces, equal the whole ones."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rootweave.sources import long_traces as L
from rootweave.sources import recordings as D

ODD = ['a "quoted" {brace', "}{][", "\\", '\\"}', "", "x],\"events\":[{", "é\n}", "tab\t"]


def _document(n, seed, indent):
    deal = random.Random(seed)
    events = []
    for i in range(n):
        one = {"type": deal.choice(["call", "return", "line", "exception"]), "function": f"f{i}", "filename": "m.py", "lineno": i, "timestamp": 0.5, "depth": 1}
        one["variables"] = {f"v{k}": deal.choice(ODD) for k in range(deal.randrange(3))}
        one["exception"] = deal.choice([None, *ODD])
        if deal.random() < 0.1:
            del one["lineno"]
        if deal.random() < 0.2:
            one["stack"] = [{"events": [{"type": "call"}]}, deal.choice(ODD)]
        events.append(one)
    before = {"meta": {"deep": {"er": {"type": "call"}}}, "other": [{"type": "call"}, 3], "none": [1, 2]}
    return json.dumps({**before, "events": events, "last_exception": {"type": "E", "message": "}"}, "after": [{"type": "call"}], "m": {"b": {"c": 1}}}, indent=indent, ensure_ascii=bool(seed % 2))


@pytest.mark.parametrize("block", [900, 1 << 20])
def test_pieces_give_the_events_of_whole_documents(spark, tmp_path, block):
    for seed in range(6):
        (tmp_path / f"t{seed}.json").write_text(_document(25, seed, [None, 2][seed % 2]))
    (tmp_path / "empty.json").write_text('{"events": [], "last_exception": null}\n')
    whole = sorted(map(str, D.read_traces(spark, str(tmp_path)).withColumn("run_id", F.substring_index("run_id", "/", -1)).collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = L.read_long_traces(spark, str(tmp_path)).withColumn("run_id", F.substring_index("run_id", "/", -1))
        rows = sorted(map(str, found.collect()))
        few = L.read_long_traces(spark, str(tmp_path), max_events=5).agg(F.max("seq")).first()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == whole and len(rows) > 100 and few == 4


def test_a_cut_document_gives_what_comes_before(spark, tmp_path):
    text = _document(10, 1, None)
    (tmp_path / "t.json").write_text(text[: text.index('"f6"')])
    assert L.read_long_traces(spark, str(tmp_path)).agg(F.max("seq")).first()[0] == 5


def test_parts_are_the_document(spark, tmp_path):
    kind = F.when(F.col("id") % 10 == 9, "exception").otherwise("call")
    events = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "a b/c").otherwise("r").alias("run_id"), (F.col("id") * 7).alias("seq"), kind.alias("type"), F.concat(F.lit("f}"), F.col("id").cast("string")).alias("function"),
        F.lit("m.py").alias("filename"), F.col("id").cast("int").alias("lineno"), F.when(kind == "exception", F.concat(F.lit('E: "'), F.col("id").cast("string"))).alias("exception"),
    )
    parts = L.trace_parts(events, 64)
    got = {}
    for r in sorted(parts.collect(), key=lambda r: (r["run_id"], r["part"])):
        got[r["run_id"]] = got.get(r["run_id"], "") + r["document"]
        assert r["document"].count('"function"') <= 64
    assert got == {r["run_id"]: r["document"] for r in D.trace_documents(events).collect()}
    L.write_trace_parts(parts, str(tmp_path / "out"))
    read = L.read_long_traces(spark, str(tmp_path / "out"), folders=True).select("run_id", "seq", "function", "exception")
    expected = D.traces_of(D.trace_documents(events)).select("run_id", "seq", "function", "exception")
    assert sorted(map(str, read.collect())) == sorted(map(str, expected.collect())) and read.count() == 1000
