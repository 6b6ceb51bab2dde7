"""Property graphs as node and edge tables; `ord`, a number or a struct of path and place, carries insertion order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources of the merged graph in merge order.
SOURCES = ("ast", "dependency", "callgraph", "cfg", "dataflow", "runtime")
# Kinds on merge.
NODE_KINDS = {"file": "module"}
BLOCK_KINDS = {"if": "condition", "while": "loop", "for": "loop", "return": "return", "except": "exception"}
DATAFLOW_EDGE_KINDS = {"defines": "writes"}


def distinct_nodes(nodes: DataFrame, keys: list[str] | None = None, flags: tuple[str, ...] = ()) -> DataFrame:
    """The first inserted row of each id, with `flags` true where any row of the id has them; partial before the shuffle."""
    keys = keys or ["id"]
    rest = [c for c in nodes.columns if c not in keys]
    first = nodes.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("_first"), *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f"_{f}") for f in flags])
    return first.select(*keys, *[(F.col(f"_{c}") if c in flags else F.col("_first")[c]).alias(c) for c in rest])


def distinct_edges(edges: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each (source, target, kind), with its least `ord`."""
    return edges.groupBy(*(extra or []), "source", "target", "kind").agg(F.min("ord").alias("ord"))


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count and edge_count."""
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).withColumn("edge_count", edges.agg(F.count(F.lit(1))).scalar())


def incident(edges: DataFrame, nodes: DataFrame, end: str, kind: str | None = None) -> DataFrame:
    """Edges of one kind whose `end` (source or target) is among `nodes`(id)."""
    chosen = edges if kind is None else edges.filter(F.col("kind") == kind)
    return chosen.join(nodes.select(F.col("id").alias(end)), end, "left_semi")


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return incident(incident(edges, ids, "source"), ids, "target")


def mapped_kind(kind: Column, pairs: dict[str, str]) -> Column:
    out = kind
    for old, new in pairs.items():
        out = F.when(kind == old, F.lit(new)).otherwise(out)
    return out


def merged(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of tagged tables; insertion order is source order, then order inside the source."""
    def tag(name: str, df: DataFrame) -> DataFrame:
        return df.withColumn("ord", F.struct(F.lit(SOURCES.index(name)).alias("source_rank"), F.col("ord").alias("place"))).withColumn("origin", F.lit(name))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tag(n, df) for n, df in parts])
