"""A bounded cache of parsed modules as a table, by (language, path, content).

Each batch of files is joined to the cache: known modules are taken from it, the others parsed, and both are written back as just used. Where
the table then holds more than `capacity` modules, the least recently used go: a histogram of the batches of last use gives the batch at which
the capacity is reached, later ones stay whole, and of that batch as many of the last paths as fit. The table is rewritten for every batch, which
its capacity bounds. Files that fail to parse are not cached.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.functions.text import content_key
from rootweave.operators.traverse import kept
from rootweave.sources.versions import Conflict, Versions
from rootweave.sources import parsers as P

KEY = ["language", "path", "content_key"]
CACHED = f"{P.MODULES}, content_key string, used long"


def newest(rows: DataFrame, capacity: int) -> DataFrame:
    """The `capacity` most recently used rows: by batch, then the last paths of the batch that the limit cuts."""
    earlier = Window.orderBy(F.desc("used")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each batch
    sizes = rows.groupBy("used").agg(F.count(F.lit(1)).alias("n")).withColumn("after", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cut = sizes.filter((F.col("after") < capacity) & (F.col("after") + F.col("n") >= capacity)).first()
    if cut is None:
        return rows
    last = rows.filter(F.col("used") == cut["used"]).orderBy(F.desc("path"), F.desc("language"), "content_key").limit(capacity - cut["after"])
    return rows.filter(F.col("used") > cut["used"]).unionByName(last)


class ParseCache:
    def __init__(self, spark: SparkSession, folder: str, capacity: int = 2048) -> None:
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        self.spark, self.folder, self.capacity = spark, folder.rstrip("/"), capacity
        self.versions = Versions(spark, self.folder)

    def _state(self) -> dict:
        return {"table": None, "size": 0, "hits": 0, "misses": 0, "batch": 0} | self.versions.latest()[1]

    def table(self) -> DataFrame:
        """Cached modules with their content key and the batch of their last use."""
        name = self._state()["table"]
        return self.spark.read.schema(CACHED).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], CACHED)

    @property
    def size(self) -> int:
        return self._state()["size"]

    @property
    def hit_count(self) -> int:
        return self._state()["hits"]

    @property
    def miss_count(self) -> int:
        return self._state()["misses"]

    def clear(self) -> None:
        """Forget all modules, and the counts of hits and misses."""
        self.versions.commit(self.versions.latest()[0] + 1, {"table": None, "size": 0, "hits": 0, "misses": 0, "batch": self._state()["batch"]})

    def modules(self, files: DataFrame) -> DataFrame:
        """Parsed modules of files(path, language, text); what the cache lacks is parsed and kept in it."""
        columns = [c for c in self.table().columns if c not in ("content_key", "used")]
        keyed = files.filter(F.col("language").isNotNull()).withColumn("content_key", content_key(F.col("text")))
        while True:
            number = self.versions.latest()[0]
            state, cache = self._state(), self.table()
            known = keyed.select(*KEY).join(cache.drop("used"), KEY)
            missing = keyed.join(cache.select(*KEY), KEY, "left_anti")
            parsed = P.modules(missing).join(missing.select(*KEY), ["language", "path"])
            found = kept(known.withColumn("hit", F.lit(True)).unionByName(parsed.withColumn("hit", F.lit(False))), "cached-modules")
            counts = found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).first()
            batch = state["batch"] + 1
            used = found.filter("parse_error IS NULL").drop("hit").withColumn("used", F.lit(batch).cast("long")).dropDuplicates(KEY)
            others = cache.join(found.select(*KEY), KEY, "left_anti")
            name = f"modules-{uuid.uuid4().hex}"
            newest(others.unionByName(used), self.capacity).write.parquet(f"{self.folder}/{name}")
            size = self.spark.read.schema(CACHED).parquet(f"{self.folder}/{name}").count()
            new = {"table": name, "size": size, "hits": state["hits"] + counts["hits"], "misses": state["misses"] + counts["misses"], "batch": batch}
            try:
                self.versions.commit(number + 1, new)
                return found.select(*columns)
            except Conflict:  # another batch was first
                continue
