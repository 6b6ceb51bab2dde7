"""Live events out of order give what the batch operator gives."""

import json
import random

from pyspark.sql import functions as F

from rootweave.operators import trace as X
from rootweave.streaming.replay import TIMED, live_ordered_depths

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_shuffled_micro_batches_equal_the_batch(spark, tmp_path):
    rng = random.Random(6)
    stamp = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    events = [{"run_id": run, "seq": i, "type": rng.choice(["call", "call", "return", "line"]), "function": "f", "filename": "a.py", "at": stamp(i)} for run in ("a", "b") for i in range(40)]
    lost = {("b", 17)}
    sent = [e for e in events if (e["run_id"], e["seq"]) not in lost]
    parts = [sent[i : i + 26] for i in range(0, len(sent), 26)]
    shuffled = [e for part in [sent] for e in rng.sample(part, len(part))]
    parts = [shuffled[i : i + 26] for i in range(0, len(shuffled), 26)]
    later = [{**events[0], "run_id": "c", "seq": n, "at": stamp(3000 + n)} for n in range(2)]
    source = tmp_path / "in"
    source.mkdir()
    for n, part in enumerate([*parts, later[:1], later[1:]]):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        __import__("os").utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).json(str(source))
        found = live_ordered_depths(stream, "2 minutes", 60_000)
        query = found.writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(150)
        assert query.exception() is None
    finally:
        spark.conf.set(PROVIDER, old)
    rows = spark.table("ordered").filter("run_id <> 'c'").collect()
    batch = spark.createDataFrame([(e["run_id"], e["seq"], e["type"]) for e in sent], "run_id string, seq long, type string")
    expected = X.stack_depths(X.bucketed(batch)).select("run_id", "seq", "type", F.col("stack_depth").cast("long").alias("stack_depth")).collect()
    assert sorted(rows) == sorted(expected)
    for run in "ab":  # and each run came out in its order
        assert [r["seq"] for r in rows if r["run_id"] == run] == sorted(r["seq"] for r in rows if r["run_id"] == run)
