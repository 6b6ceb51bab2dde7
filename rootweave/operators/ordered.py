"""Prefix computations over long ordered runs, in two levels.

A run may hold a third of all rows, so no window spans a run. Rows are windowed inside (run, bucket); one row
for each bucket carries totals, last values and running minima from bucket to bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Runs:
    """How rows are ordered: run and bucket columns, and unique order columns inside a bucket.

    Buckets must ascend with the order.
    """

    run: str
    bucket: str
    order: list = field(default_factory=list)

    def inside(self):
        return Window.partitionBy(self.run, self.bucket).orderBy(*self.order)

    def before(self):
        return self.inside().rowsBetween(Window.unboundedPreceding, -1)

    def earlier_buckets(self):
        return Window.partitionBy(self.run).orderBy(self.bucket).rowsBetween(Window.unboundedPreceding, -1)

    def _joined(self, df: DataFrame, per_bucket: DataFrame) -> DataFrame:
        return df.join(per_bucket, [self.run, self.bucket])

    def numbered(self, df: DataFrame, name: str = "seq") -> DataFrame:
        """Zero-based position in the run, as a long."""
        sizes = df.groupBy(self.run, self.bucket).agg(F.count(F.lit(1)).alias("_n"))
        base = sizes.select(self.run, self.bucket, F.coalesce(F.sum("_n").over(self.earlier_buckets()), F.lit(0)).alias("_base"))
        placed = self._joined(df, base).withColumn(name, F.col("_base") + F.row_number().over(self.inside()) - 1)
        return placed.withColumn(name, F.col(name).cast("long")).drop("_base")

    def lagged(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """The value of the row before, across buckets."""
        ends = df.groupBy(self.run, self.bucket).agg(F.max_by(F.struct(column), F.struct(*self.order)).alias("_end"))
        carried = ends.select(self.run, self.bucket, F.lag("_end").over(Window.partitionBy(self.run).orderBy(self.bucket))[column].alias("_carried"))
        first = F.row_number().over(self.inside()) == 1
        within = F.lag(column).over(self.inside())
        return self._joined(df, carried).withColumn(name, F.when(first, F.col("_carried")).otherwise(within)).drop("_carried")

    def floored_sum(self, df: DataFrame, delta: Column, name: str, carried: dict[str, Column] | None = None) -> DataFrame:
        """Sum of `delta` over all rows before, clamped at zero after every row.

        With prefix sums S, the clamped sum is S - min(0, least S so far). `carried` names sums of whole runs
        that ride along: {name: column summed over the run}.
        """
        work = df.withColumn("_d", delta.cast("long"))
        work = work.withColumn("_s", F.sum("_d").over(self.inside().rowsBetween(Window.unboundedPreceding, 0)))
        carried = carried or {}
        totals = work.groupBy(self.run, self.bucket).agg(F.sum("_d").alias("_total"), F.min("_s").alias("_low"), *[F.sum(c).alias(k) for k, c in carried.items()])
        totals = totals.withColumns({k: F.sum(k).over(Window.partitionBy(self.run)) for k in carried})
        totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(self.earlier_buckets()), F.lit(0)))
        totals = totals.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_low")).over(self.earlier_buckets()), F.lit(0))))
        work = self._joined(work, totals.select(self.run, self.bucket, "_base", "_floor", *carried))
        so_far = F.col("_base") + F.coalesce(F.sum("_d").over(self.before()), F.lit(0))
        least = F.least(F.col("_floor"), F.coalesce(F.col("_base") + F.min("_s").over(self.before()), F.lit(0)))
        return work.withColumn(name, (so_far - least).cast("long")).drop("_d", "_s", "_base", "_floor")
