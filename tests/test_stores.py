"""Record log and parse cache: what they hold, how much a look-up reads, and two writers."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rootweave.plans.records import RECORDS, Missing, Registry
from rootweave.sources.parse_cache import ParseCache
from rootweave.sources.versions import Conflict, Versions

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def _changes(spark, first, n):
    """n changes of a thousand ids, the later ones at later times."""
    at = F.lit(START) + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))
    rows = spark.range(first, first + n).withColumn("at", at)
    return rows.select(
        F.lit("analysis").alias("kind"), F.concat(F.lit("r"), F.col("id") % 1000).alias("id_"), F.lit("p").alias("project_id"), F.when(F.col("id") % 2 == 0, "running").otherwise("ready").alias("status"),
        "at", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("location"), F.col("id").alias("ord"), F.col("at").alias("created_at"),
    ).withColumnRenamed("id_", "id")


def test_a_listing_reads_two_files_after_ten_thousand_changes(spark, tmp_path):
    registry = Registry(spark, f"file://{tmp_path}", tail_rows=600)
    for first in range(0, 10_000, 2500):
        registry.append(_changes(spark, first, 2500))
    registry.append(_changes(spark, 10_000, 3))
    registry.put("analysis", "r0", "p", "failed", "broken")
    table = registry.table()
    assert len(table.inputFiles()) <= 2 and table.count() == 1000
    assert registry.state("r0")["status"] == "failed" and registry.state("r0")["created_at"].replace(tzinfo=None) == START.replace(tzinfo=None)
    assert registry.state("r2")["ord"] == 10_002 and registry.state("r7")["ord"] == 9007
    assert [r["id"] for r in registry.listed("analysis", 2).collect()] == ["r999", "r998"]
    with pytest.raises(Missing):
        registry.state("r1000")
    assert registry.state("r5")["updated_at"].replace(tzinfo=None) == (START + timedelta(seconds=9005)).replace(tzinfo=None)


def test_two_writers(spark, tmp_path):
    one, two = (Registry(spark, f"file://{tmp_path}") for _ in range(2))
    first = one.append(_changes(spark, 0, 5))
    two.append(_changes(spark, 5, 5), expected=first)
    with pytest.raises(Conflict):
        one.append(_changes(spark, 10, 5), expected=first)
    one.append(_changes(spark, 10, 5))  # follows the other
    assert two.table().count() == 15
    versions = Versions(spark, f"file://{tmp_path}/records")
    with pytest.raises(Conflict):
        versions.commit(versions.latest()[0], {})
    assert versions.latest()[0] == 3


def _files(spark, names, body="x = 1\n"):
    return spark.createDataFrame([(n, "Python", body) for n in names], "path string, language string, text string")


def test_cache_capacity_order_and_counters(spark, tmp_path):
    cache = ParseCache(spark, f"file://{tmp_path}", capacity=4)
    paths = lambda: sorted(r["path"] for r in cache.table().collect())
    assert (cache.size, cache.hit_count, cache.miss_count) == (0, 0, 0)
    got = cache.modules(_files(spark, "abc"))
    assert sorted(r["path"] for r in got.collect()) == ["a", "b", "c"] and got.first()["variables"][0]["name"] == "x"
    assert (cache.size, cache.hit_count, cache.miss_count) == (3, 0, 3)
    cache.modules(_files(spark, "ad"))  # b and c are now the oldest
    assert paths() == ["a", "b", "c", "d"] and (cache.hit_count, cache.miss_count) == (1, 4)
    cache.modules(_files(spark, "e"))  # of b and c, used together, the first path goes
    assert paths() == ["a", "c", "d", "e"]
    cache.modules(_files(spark, "a", "y = 2\n"))  # changed content is another entry
    assert paths() == ["a", "a", "d", "e"] and (cache.hit_count, cache.miss_count) == (1, 6)
    broken = cache.modules(_files(spark, "f", "def :\n"))
    assert broken.first()["parse_error"] is not None and "f" not in paths() and cache.size == 4
    again = ParseCache(spark, f"file://{tmp_path}", capacity=2)  # another session, with less room
    again.modules(_files(spark, "ghi"))
    assert paths() == ["h", "i"] and again.size == 2
    again.clear()
    assert (again.size, again.hit_count, again.miss_count) == (0, 0, 0)
    with pytest.raises(ValueError):
        ParseCache(spark, f"file://{tmp_path}", capacity=0)
