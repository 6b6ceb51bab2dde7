"""Traces that no row can hold: a run's JSON document as ordered parts, and documents of any length read piece by piece.

A document is cut at every closing brace, so a piece is shorter than an event. Whether a piece is inside a text, and how
deep, follows from all pieces before it; both are prefix sums, taken inside the blocks of a file and carried from block to
block, so blocks of one document are read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.functions.text import exception_message, exception_type
from rootweave.operators.ranges import in_ranges
from rootweave.sources.recordings import EVENT, valid_event

_OPENED = r'"(\w+)"\s*:\s*\[[^\[\]{}]*\{'
_LEFT = r'(?s)^(?:[^{}\[\]"]|"(?:\\.|[^"\\])*")*\]'  # an array ends before anything in it opens
_BLOCK = ["run_id", "file", "block"]


def trace_parts(events: DataFrame, per_part: int = 10_000) -> DataFrame:
    """run_id, part, document: parts of at most `per_part` events that joined in order are the run's JSON document.

    events(run_id, seq, ...) has no ties of (run_id, seq). The last part is the document's end, with type and message of the
    run's last exception or null.
    """
    fields = [c for c in events.columns if c not in ("run_id", "seq", "bucket")]
    ranked = in_ranges(events, ["run_id", "seq"]).ranked("run_id")
    part = F.floor((F.col("rank") - 1) / per_part).cast("long")
    item = F.struct("rank", F.to_json(F.struct(*fields)).alias("e"))
    grouped = ranked.groupBy("run_id", part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.when(F.col("part") == 0, '{"events":[').otherwise(",")
    parts = grouped.select("run_id", "part", F.concat(start, F.array_join(F.transform("items", lambda x: x["e"]), ",")).alias("document"))
    text = F.max_by("exception", F.when(F.col("type") == "exception", F.col("rank")))
    ends = ranked.groupBy("run_id").agg((F.max(part) + 1).alias("part"), text.alias("text"))
    last = F.to_json(F.struct(exception_type(F.col("text")).alias("type"), exception_message(F.col("text")).alias("message")))
    end = F.concat(F.lit('],"last_exception":'), F.when(F.col("text").isNull(), "null").otherwise(last), F.lit("}"))
    return parts.unionByName(ends.select("run_id", "part", end.alias("document")))


def write_trace_parts(parts: DataFrame, path: str) -> None:
    """A folder for each run, `run_id=...`, whose files joined in order of their names are its document; meant for few long runs."""
    ordered = parts.repartitionByRange("run_id", "part").sortWithinPartitions("run_id", "part")
    ordered.select("run_id", "document").write.partitionBy("run_id").text(path)


def read_long_traces(spark: SparkSession, path: str, folders: bool = False, max_events: int | None = None) -> DataFrame:
    """`recordings.traces_of` for documents that no row can hold; run_id is the file, or with `folders` what was written as run_id.

    Events are the objects of the document's `events` array, numbered from zero; malformed ones are numbered and left out, items
    that are no objects are not numbered. A document that is cut off gives the events before the cut.
    """
    read = spark.read.schema("value string, run_id string" if folders else "value string").text(path, lineSep="}")
    file = F.col("_metadata.file_path")
    run = F.col("run_id") if folders else file
    pieces = read.select(
        run.alias("run_id"), (file if folders else F.lit("")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"),
    )
    if folders:  # the line end behind a file's last brace closes nothing
        pieces = pieces.filter(F.col("text") != "\n")
    found = _numbered(_nested(pieces))
    if max_events is not None:
        found = found.filter(F.col("seq") < max_events)
    return events_of(found)


def events_of(pieces: DataFrame) -> DataFrame:
    """Well-formed events of numbered pieces(run_id, seq, file, block, at, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("file", "block", "at", "text")))
    joined = pieces.groupBy("run_id", "seq").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "}").alias("text"))
    event = F.from_json(F.concat(F.regexp_replace("text", r"^[^{]*", ""), F.lit("}")), EVENT)
    return joined.select("run_id", F.col("seq").cast("long").alias("seq"), event.alias("e")).filter(valid_event("e")).select("run_id", "seq", "e.*")


def _inside() -> Window:
    return Window.partitionBy(*_BLOCK).orderBy("at")


def _so_far(value: Column) -> Column:
    return F.sum(value).over(_inside().rowsBetween(Window.unboundedPreceding, 0))


def _before(value: Column, order: tuple[str, ...] = ()) -> Column:
    """Sum over the rows before: of the block, or of the run's blocks in `order`."""
    window = Window.partitionBy("run_id").orderBy(*order) if order else _inside()
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _nested(pieces: DataFrame) -> DataFrame:
    """Adds text_before (1 inside a text), before and after (depth, the closing brace included), closes (whether it is one)."""
    bare = F.regexp_replace("text", r"(?s)\\.", "")

    def deeper(text: Column) -> Column:
        outside = F.regexp_replace(text, r'"[^"]*("|$)', "")
        return F.regexp_count(outside, F.lit(r"[\[{]")) - F.regexp_count(outside, F.lit(r"\]"))

    rows = pieces.withColumn("quotes", F.regexp_count(bare, F.lit('"')))
    even = F.col("quotes") % 2 == 0
    # The step in depth of a piece that begins outside a text, or inside one; the brace counts where the piece ends outside.
    rows = rows.withColumns({"plain": deeper(bare) - F.when(even, 1).otherwise(0), "quoted": deeper(F.concat(F.lit('"'), bare)) - F.when(even, 0).otherwise(1)})
    rows = rows.withColumn("turns", _before(F.col("quotes")) % 2)
    for entry in (0, 1):  # the block begins outside a text, or inside one
        rows = rows.withColumn(f"step{entry}", F.when(F.col("turns") == entry, F.col("plain")).otherwise(F.col("quoted")))
        rows = rows.withColumn(f"depth{entry}", _so_far(F.col(f"step{entry}")))
    blocks = rows.groupBy(*_BLOCK).agg(F.sum("quotes").alias("quotes"), F.sum("step0").alias("step0"), F.sum("step1").alias("step1"))
    blocks = blocks.withColumn("entry", _before(F.col("quotes"), ("file", "block")) % 2)
    blocks = blocks.withColumn("base", _before(F.when(F.col("entry") == 0, F.col("step0")).otherwise(F.col("step1")), ("file", "block")))
    rows = rows.join(blocks.select(*_BLOCK, "entry", "base"), _BLOCK)
    chosen = lambda name: F.when(F.col("entry") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    after, begins = F.col("base") + chosen("depth"), (F.col("turns") + F.col("entry")) % 2
    return rows.select(
        *_BLOCK, "at", "text", begins.alias("text_before"), (after - chosen("step")).alias("before"), after.alias("after"),
        ((begins + F.col("quotes")) % 2 == 0).alias("closes"),
    )


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces of the objects of the `events` array, with seq, the object's number."""
    at_top = (F.col("before") <= 1) | ((F.col("before") == 2) & F.col("text").rlike(_LEFT))
    # The array that a piece of the top level opens, or none; null inside an array.
    opens = F.when((F.col("text_before") == 0) & at_top, F.regexp_extract("text", _OPENED, 1))
    rows = pieces.withColumn("opens", opens).withColumn("ends", F.col("closes") & (F.col("after") == 2))
    rows = rows.withColumn("array", F.last("opens", ignorenulls=True).over(_inside().rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy(*_BLOCK).agg(
        F.max_by("opens", F.when(F.col("opens").isNotNull(), F.col("at"))).alias("left"),
        F.count_if(F.col("ends") & (F.col("array") == "events")).alias("own"), F.count_if(F.col("ends") & F.col("array").isNull()).alias("carried_on"),
    )
    earlier = Window.partitionBy("run_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.last("left", ignorenulls=True).over(earlier))
    total = F.col("own") + F.when(F.col("carried") == "events", F.col("carried_on")).otherwise(0)
    blocks = blocks.withColumn("base", _before(total, ("file", "block"))).select(*_BLOCK, "carried", "base")
    rows = rows.join(blocks, _BLOCK).withColumn("array", F.coalesce("array", "carried"))
    rows = rows.withColumn("seq", F.col("base") + _before((F.col("ends") & (F.col("array") == "events")).cast("long")))
    head = F.regexp_replace("text", r'(?s)^.*?"\w+"\s*:\s*\[[^\[\]{}]*(?=\{)', "")
    kept = rows.filter((F.col("array") == "events") & (F.col("after") >= 2))
    return kept.select(*_BLOCK, "at", "seq", F.when(F.col("opens").isNotNull(), head).otherwise(F.col("text")).alias("text"))
