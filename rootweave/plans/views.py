"""The star-schema tables as traces, graphs, files, runs, cases and evidence; whole tables, derived by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.operators.ordered import Runs

EVENT_TYPES = {"click": "call", "purchase": "return", "error": "exception"}
_EVENT_RUNS = Runs("run_id", "bucket", ["ts", "event_id"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trace events; a run is a user, buckets are days."""
    events = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("int")
    kind = F.lit("line")
    for raw, name in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == raw, F.lit(name)).otherwise(kind)
    rows = events.select(
        F.col("user_id").alias("run_id"), F.to_date("ts").alias("bucket"), "ts", "event_id", kind.alias("type"),
        F.concat(F.lit("fn"), (k % 12).cast("string")).alias("function"), F.concat(F.lit("m"), (k % 5).cast("string"), F.lit(".py")).alias("filename"),
        F.when(kind == "exception", F.concat(F.lit("Error"), (k % 7).cast("string"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(": code "), k.cast("string"))))).alias("exception"),
    )
    return _EVENT_RUNS.numbered(rows, "seq").withColumn("node_id", F.concat_ws("::", "filename", "function"))


def call_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target) parts of consecutive lines of an order; orders are small, so a window holds one."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    steps = items.select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(order).alias("target"))
    return steps.filter("target IS NOT NULL AND source <> target")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_steps(spark, sf_dir).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rootweave.functions.text import line_count

    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), line_count(F.col("text")).alias("lines"), "text")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("ord"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, source, score): users as nodes, event types as sources."""
    events = table(spark, sf_dir, "events")
    best = events.groupBy(F.col("user_id").alias("node"), F.col("event_type").alias("source")).agg(F.max("value").alias("v"))
    return best.select("node", "source", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") / 100)).cast("decimal(5,4)").alias("score"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as test cases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), (F.col("n_chars").cast("decimal(18,3)") / 1000).cast("decimal(18,3)").alias("duration_seconds"))
    outcome = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "passed").when((F.col("quality") == 1) & (F.col("toxic") == 1), "skipped").when(F.col("toxic") == 1, "error").otherwise("failed")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "language", outcome.alias("outcome"), "duration_seconds",
        F.when((F.col("quality") == 1) & (F.col("doc_id") % 29 == 3), F.concat(F.lit("no link for "), "language")).alias("suite_error"),
    )
