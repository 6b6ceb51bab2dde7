"""Replay of recorded execution events: depth, links, counts, sequences, exceptions, paging.

Events have run_id, seq (position in the run, the authoritative order), bucket (ascending with seq), type, function,
filename, and what else the caller carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.functions.text import exception_message, exception_type
from rootweave.operators.ordered import Runs
from rootweave.operators.ranges import in_ranges

CALL, RETURN, LINE, EXCEPTION = "call", "return", "line", "exception"
RUNS = Runs("run_id", "bucket", ["seq"])


def bucketed(events: DataFrame, span: int = 4096) -> DataFrame:
    """Buckets of `span` positions, for events that have none."""
    return events.withColumn("bucket", F.floor(F.col("seq") / span))


def stack_depths(events: DataFrame, **carried) -> DataFrame:
    """stack_depth before each event takes effect: calls open a frame, returns close one, never below zero."""
    delta = F.when(F.col("type") == CALL, 1).when(F.col("type") == RETURN, -1).otherwise(0)
    return RUNS.floored_sum(events, delta, "stack_depth", carried)


def replay_steps(events: DataFrame) -> DataFrame:
    """Depth, position, total and the neighbours' indexes of every event; the total comes with the row of its bucket."""
    steps = stack_depths(events, total=F.lit(1))
    index = F.col("seq")
    return steps.select(
        *[c for c in steps.columns if c != "total"], index.alias("index"), (index + 1).alias("position"), "total",
        F.when(index > 0, index - 1).alias("previous_index"), F.when(index + 1 < F.col("total"), index + 1).alias("next_index"),
    )


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("n"))


def bounds(events: DataFrame) -> DataFrame:
    """First and last index of each run."""
    return events.groupBy("run_id").agg(F.min("seq").alias("first_index"), F.max("seq").alias("last_index"))


def max_stack_depth(events: DataFrame) -> DataFrame:
    return stack_depths(events).groupBy("run_id").agg(F.coalesce(F.max("stack_depth"), F.lit(0)).alias("max_depth"))


def matching(events: DataFrame, event_type: str | None = None, function: str | None = None) -> DataFrame:
    """Exact type and function substring, each optional."""
    if event_type is not None:
        events = events.filter(F.col("type") == event_type)
    if function is not None:
        events = events.filter(F.col("function").contains(function))
    return events


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 100, near: int = 10_000) -> DataFrame:
    """A slice of the ordered rows; each row carries the total before slicing.

    A page that ends before `near` is a top-k. A later one is found by its offset: rows are dealt to sampled ranges, counts say which
    ranges hold the page, and only those are read. Who turns many pages keeps the ranges (operators/ranges.py).
    """
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    if offset + limit > near:
        return in_ranges(rows, order).page(offset, limit)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total_matched", total)


def last_exception(events: DataFrame) -> DataFrame:
    """Type and message of the last exception event of each run."""
    found = events.filter(F.col("type") == EXCEPTION).groupBy("run_id").agg(F.max_by(F.struct("seq", "function", "exception"), "seq").alias("e"))
    text = F.col("e.exception")
    return found.select("run_id", F.col("e.seq").alias("index"), F.col("e.function").alias("function"), exception_type(text).alias("exception_type"), exception_message(text).alias("exception_message"))


def execution_sequence(calls: DataFrame, node: str = "node_id") -> DataFrame:
    """Call events without those that repeat the node just before them."""
    lagged = RUNS.lagged(calls, node, "_before")
    return lagged.filter(~F.col(node).eqNullSafe(F.col("_before"))).drop("_before")


def executes_after(calls: DataFrame, node: str = "node_id") -> DataFrame:
    """Distinct (source, target) of consecutive, different nodes."""
    paired = RUNS.lagged(execution_sequence(calls, node), node, "_before")
    return paired.filter(F.col("_before").isNotNull()).select("run_id", F.col("_before").alias("source"), F.col(node).alias("target")).distinct()


def executed_order(calls: DataFrame, node: str = "node_id") -> DataFrame:
    """Nodes of each run by first occurrence."""
    return calls.groupBy("run_id", node).agg(F.min("seq").alias("first_seq"))


def function_order(events: DataFrame) -> DataFrame:
    """Functions of call events in order, repeats kept: a row for each, as a run may hold any number of calls."""
    return RUNS.numbered(matching(events, CALL), "place").select("run_id", "place", "function")


def without_leading(frames: Column, owner: str) -> Column:
    """An array of frames without those at its start that lie in the file `owner`; `frames` is computed once."""

    def rest(found: Column) -> Column:
        other = F.array_position(F.transform(found, lambda f: f["file"] != owner), F.lit(True))
        return F.when(other > 0, F.slice(found, other.cast("int"), F.greatest(F.size(found), F.lit(1)))).otherwise(F.slice(found, F.lit(1), F.lit(0)))

    return F.get(F.transform(F.array(frames), rest), F.lit(0))
