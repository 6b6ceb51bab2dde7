"""Shared helpers: the cluster's shared folder, written intermediate tables, column hygiene."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, in local mode (tests), a new temporary one."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_rootweave_shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext._rootweave_shared = folder
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were not started from its folder."""
    context = spark.sparkContext
    if getattr(context, "_rootweave_shipped", False):
        return
    roots = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(PACKAGE.parent) not in roots:
        import shutil

        base = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "rootweave")
        context.addPyFile(shutil.make_archive(base, "zip", PACKAGE.parent, PACKAGE.name))
    context._rootweave_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rootweave-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table carries; null text counts as empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined_by_key(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, hubs: int = 2000) -> DataFrame:
    """rows inner-joined with `keyed`, which has one row for each key; `weight` says how many rows hold it, of `total`.

    Fewer than `hubs` keys can hold more than a `hubs`-th of all rows each. Those go to all tasks, so the
    rows of a hot key stay where they are; the others meet by a shuffle.
    """
    hot = F.col(weight) > total // hubs + 1
    values = [c for c in keyed.columns if c != key]
    top = keyed.filter(hot).select(key, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(top), key, "left")
    busy = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in values])
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns)
    return busy.unionByName(rest.join(keyed.filter(~hot), key).select(*rows.columns, *values))


def met_by_key(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, hubs: int = 2000) -> DataFrame:
    """joined_by_key in one pass of the rows; `keyed` should be a written table, as it is read twice.

    Rows that have met a hot key go on to tasks of their own, by salts that no other key has.
    """
    hot = F.col(weight) > total // hubs + 1
    values = F.struct(*[c for c in keyed.columns if c != key])
    marked = rows.join(F.broadcast(keyed.filter(hot).select(key, values.alias("_hot"))), key, "left")
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int") + 1)
    rest = keyed.filter(~hot).select(key, values.alias("_rest"), F.lit(0).alias("_salt"))
    met = marked.withColumn("_salt", salt).join(rest, [key, "_salt"], "left").withColumn("_met", F.coalesce("_hot", "_rest"))
    return met.filter(F.col("_met").isNotNull()).select(*rows.columns, "_met.*")


def batches_of_rows(batch, columns: list[str], size: int = 128):
    """Lists of Python values for `columns`, a few rows at a time so that memory follows the slice."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
