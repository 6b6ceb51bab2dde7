"""Line deduplication with levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased; keys are
held as MD5 hex. Documents arrive in batches. A batch is reduced to (key, n_docs, max_doc), one row
for each key, with a partial aggregate before its shuffle, so a key that most documents hold is one
row for each task. The batch is merge-anti-joined with the runs: keys that no run holds are marked as first
seen. It then becomes a run of its own at level 0, a table bucketed and sorted by key. When a level
holds `fanout` runs they are merged (counts added, ids maximised) to one run of the next level;
bucketed runs meet without a shuffle. A key can only be common if a later batch saw it again or one run
alone counts enough documents for it; so the many keys that one batch saw once are never totalled.

Documents are rows: a null text is one empty line; a null doc_id is smaller than any other; rows
with equal ids count one by one and are told apart by their text. Empty tables give no rows. Lines
and texts of any length are taken whole. Extra columns are ignored. The tables of the runs are dropped
from the catalogue when their totals are written; their files stay in the shared folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.llm.common import joined_by_key, scratch_path, shuffle_partitions, texts, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column, min_chars: int) -> Column:
    """MD5 of the normalised line, null where it has fewer than `min_chars` code points."""
    bare = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    folded = F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))
    return F.when(F.char_length(bare) >= min_chars, F.md5(folded.cast("binary")))


class LineRuns:
    """Runs by level; each a bucketed, sorted table (key, n_docs, max_doc, first_seen) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet")
            .option("path", scratch_path(self.spark, name)).saveAsTable(name))
        self.names.append(name)
        return name

    def close(self) -> None:
        """Take the tables of all runs out of the catalogue."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _merged(self, names: list[str]) -> DataFrame:
        all_rows = reduce(DataFrame.unionByName, [self.spark.table(n) for n in names])
        return all_rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.bool_or("first_seen").alias("first_seen"))

    def _known(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _marked(self, batch: DataFrame) -> DataFrame:
        """The batch with `first_seen`: one merge join for each run, newest first; unmatched rows are the anti-join."""
        unseen = F.lit(True)
        for i, name in enumerate(self._known()):
            batch = batch.join(self.spark.table(name).select("key", F.lit(i).alias(f"run_{i}")), "key", "left")
            unseen = unseen & F.col(f"run_{i}").isNull()
        return batch.select("key", "n_docs", "max_doc", unseen.alias("first_seen"))

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch (key, doc_id), one row for each key of a document; return the keys that it saw first."""
        batch = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        name = self._write(self._marked(batch))
        if not self.levels:
            self.levels.append([])
        self.levels[0].insert(0, name)
        return self.spark.table(name).filter("first_seen").select("key")

    def compact(self) -> None:
        """Merge every level that is full into one run of the level above."""
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                name = self._write(self._merged(self.levels[at]))
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].insert(0, name)
                self.levels[at] = []
            at += 1

    def common(self, min_docs: int) -> DataFrame:
        """key, n_docs, max_doc of the keys of at least `min_docs` documents."""
        rows = reduce(DataFrame.unionByName, [self.spark.table(n) for n in self._known()])
        possible = rows.filter(~F.col("first_seen") | (F.col("n_docs") >= min_docs)).select("key").distinct()
        totals = rows.join(possible, "key", "left_semi").groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        return totals.filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, carry: bool = False, batch_docs: int = 20_000_000) -> DataFrame:
    """doc_id, text, kept, n_lines, n_dropped for every document; with `carry` its row, too, as a struct.

    There are at least `batches` batches, and more where they would hold over `batch_docs` documents.

    Keys found in at least `min_docs` documents lose all their lines except in the largest doc_id
    that holds them. Keys of all texts are computed once and written by batch; each batch goes
    through the runs; the totals then mark (document, position) pairs.
    """
    spark = docs.sparkSession
    batches = max(batches, -(-docs.count() // batch_docs))
    extra = ["row"] if carry else []
    plain = texts(docs)
    if carry:
        plain = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
        plain = plain.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"), "row")
    plain = plain.withColumn("row_hash", F.xxhash64("text"))
    keyed = plain.select(
        "doc_id", "row_hash", F.transform(lines_of(F.col("text")), lambda line: line_key(line, min_chars)).alias("keys"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
    )
    path = scratch_path(spark, "line-keys")
    keyed.write.partitionBy("batch").parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for batch in range(batches):
        held = keyed.filter(F.col("batch") == batch).select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
        runs.add(held.filter(F.col("key").isNotNull()))
        runs.compact()
    common = written(runs.common(min_docs), "line-common")
    runs.close()
    total = common.agg(F.sum("n_docs")).first()[0] or 0
    places = keyed.select("doc_id", "row_hash", F.posexplode("keys").alias("at", "key")).filter(F.col("key").isNotNull())
    lost = joined_by_key(places, common, "key", "n_docs", total).filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    lost = lost.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("at")).alias("lost"))
    lost = written(lost, "lost-lines").withColumnsRenamed({"doc_id": "lost_id", "row_hash": "lost_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("row_hash") == F.col("lost_hash"))
    # a sort-merge join: texts move once, however few lines are lost
    joined = plain.join(lost.hint("merge"), same, "left").select("doc_id", "text", "lost", *extra)
    n = F.size("lost")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("lost", i - 1) + 1)
    end = lambda i: F.when(i == n, F.size("lines")).otherwise(F.get("lost", i))
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice("lines", start(i) + 1, end(i) - start(i)))
    lines = joined.withColumn("lines", F.when(F.col("lost").isNotNull(), lines_of(F.col("text"))))
    return lines.select(
        "doc_id", "text",
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n")).alias("kept"),
        (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_dropped"), *extra,
    )
