"""Bounded reverse breadth-first search, from one start or from those of many runs, and reachability to a fixpoint."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from rootweave.operators.adjacency import Adjacency


def reverse_depths(edges: DataFrame | Adjacency, start: DataFrame, kind: str | None = None, limit: int = 3) -> DataFrame:
    """node, depth of what reaches `start`(id) in at most `limit` steps, start excluded; an unrolled plan.

    Edges that are not stored yet are stored by target first, so that no step moves them.
    """
    from rootweave.operators.adjacency import by_target, stored

    if isinstance(edges, DataFrame):
        edges = stored(edges if kind is None else edges.filter(F.col("kind") == kind))
    chosen = by_target(edges)
    chosen = (chosen if kind is None else chosen.filter(F.col("kind") == kind)).select("source", "target")
    seen = start.select(F.col("id").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, limit + 1):
        step = chosen.join(frontier.select(F.col("node").alias("target")), "target").select(F.col("source").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0").select("node", F.col("depth").cast("long").alias("depth"))


def run_depths(edges: DataFrame | Adjacency, start: DataFrame, kind: str, limit: int = 3) -> DataFrame:
    """run_id, node, depth of what reaches a run's `start`(run_id, id) in at most `limit` steps, the start excluded.

    All runs are searched at once. A step keeps the nodes that it finds again, and the least depth is taken at the end, so
    that no step waits for an anti-join. Over edges that are not stored by target every frontier is written, so that its size is known
    and edges stay where they are while it is small.
    """
    from rootweave.operators.adjacency import by_target

    chosen = by_target(edges).filter(F.col("kind") == kind).select("source", F.col("target").alias("node"))
    frontier = start.select("run_id", F.col("id").alias("node"))
    found = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, limit + 1):
        frontier = chosen.join(frontier, "node").select("run_id", F.col("source").alias("node")).distinct()
        frontier = kept(frontier, "frontier") if isinstance(edges, DataFrame) else frontier
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth)))
    least = found.groupBy("run_id", "node").agg(F.min("depth").alias("depth"))
    return least.filter("depth > 0").select("run_id", "node", F.col("depth").cast("long").alias("depth"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, where that is unset, a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_rootweave_kept", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = context._rootweave_kept = "file://" + tempfile.mkdtemp(prefix="spark-kept-")
    return folder.rstrip("/")


#: Shuffle files are deleted with the execution that wrote them.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession):
    """What is written here is read back by later plans, which do not need the shuffles behind it again."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """A table that several plans read, written in the shared folder, in a folder for each value of the column `by` if there is one."""
    path = f"{shared_folder(df.sparkSession)}/rootweave-{name}-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _without(rows: DataFrame, seen: DataFrame, column: str = "node") -> DataFrame:
    return rows.join(seen.select(F.col("node").alias(column)), column, "left_anti")


def _step(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    return edges.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()


def _squared(edges: DataFrame) -> DataFrame:
    """Pairs that two edges in a row connect."""
    on = edges.select(F.col("source").alias("_middle"), F.col("target").alias("_end"))
    return edges.join(on, edges["target"] == on["_middle"]).select("source", F.col("_end").alias("target")).distinct()


def _walks(edges: DataFrame) -> int:
    """How many walks of two edges there are, which bounds the pairs of `_squared`; counted from degrees alone."""
    into = edges.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("a"))
    out = edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("b"))
    return into.join(out, "node").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def reachable(edges: DataFrame | Adjacency, start: DataFrame, patience: int = 4, growth: float = 4.0, rounds: list | None = None) -> DataFrame:
    """Nodes that `start`(id) reaches, start included.

    The first `patience` rounds go one edge further each, which ends most graphs. What is deeper is reached by doubling:
    with S the nodes less than 2^k steps away and P the pairs 2^k steps apart, S and the ends of P from S are the
    nodes less than 2^(k+1) steps away, and P joined to itself has the pairs of the next k; pairs that end in S are
    not needed again. So rounds grow with the logarithm of the depth. Where squared pairs could be more than `growth` times
    the edges, as in wide graphs, P stays as it is and frontiers move 2^k steps a round. Every round writes what it finds, so
    a lost executor costs one round; cycles end because nodes that were seen are no frontier. `rounds` gets the new nodes' number of each round.
    """
    from rootweave.operators.adjacency import Adjacency

    chosen = edges.out.select("source", "target") if isinstance(edges, Adjacency) else kept(edges.select("source", "target").distinct(), "edges")
    rounds = [] if rounds is None else rounds
    seen = [kept(start.select(F.col("id").alias("node")).distinct(), "frontier")]

    def all_seen() -> DataFrame:
        if len(seen) > 16:
            seen[:] = [kept(reduce(DataFrame.unionByName, seen), "seen")]
        return reduce(DataFrame.unionByName, seen)

    def advanced(pairs: DataFrame, frontier: DataFrame) -> bool:
        seen.append(kept(_without(_step(pairs, frontier), all_seen()), "frontier"))
        rounds.append(seen[-1].count())
        return rounds[-1] > 0

    for _ in range(patience):
        if not advanced(chosen, seen[-1]):
            return all_seen()
    pairs = kept(_without(chosen, all_seen(), "target"), "pairs")
    most = growth * chosen.count()
    doubling = True
    while advanced(pairs, all_seen() if doubling else seen[-1]):
        doubling = doubling and _walks(pairs) <= most
        if doubling:
            pairs = kept(_without(_squared(pairs), all_seen(), "target"), "pairs")
    return all_seen()
