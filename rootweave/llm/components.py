"""Connected components by alternating large-star and small-star, as joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm.common import joined_by_key, written

HUBS = 2000


def _with_least(edges: DataFrame, ends: int) -> DataFrame:
    """Every edge (u, v) with the least neighbour of u; the minimum is partial before its shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return joined_by_key(edges, least, "u", "degree", ends, HUBS)


def large_star(edges: DataFrame, count: int) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both, 2 * count).filter(F.col("v") > F.col("u"))
    return found.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def small_star(edges: DataFrame, count: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges point to the smaller end."""
    found = _with_least(edges, count)
    out = found.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return out.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node that each node of an edge reaches (itself included).

    Rounds end when an edge table, written in the shared folder each time, repeats its count and
    checksum; then every edge leads from a node to its root. Null ends and loops are dropped.
    """
    real = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(real.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    last = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
        edges = written(small_star(large_star(edges, state[0]), state[0]), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
