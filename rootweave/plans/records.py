"""Run records and results of projects, in one folder.

Each change of a record is a row; the last row of an id counts. The rows of ids that were settled earlier are a snapshot with one
row for each, later changes are a tail of bounded size, and when the tail is full the two are compacted to a new snapshot. So a look-up
reads the snapshot and one more file, however many changes there were, and every change is a version (sources/versions.py). A result is a set of
tables, written before its record says ready; the last ready or failed record of (kind, project) stands for the project.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.operators import listing as L
from rootweave.sources.versions import Conflict, Versions

RECORDS = "kind string, id string, project_id string, status string, at timestamp, error string, location string, ord long, created_at timestamp"
#: Rows of a snapshot's file.
FILE_ROWS = 1_000_000


class NotReady(ValueError):
    """The record exists, but its result does not (yet)."""


class Missing(KeyError):
    """There is no such record, language or graph."""


def folded(history: DataFrame) -> DataFrame:
    """One row for each id: its last change, and when it was first seen."""
    rest = [c for c in history.columns if c not in ("id", "created_at")]
    last = history.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("r"), F.min("created_at").alias("created_at"))
    return last.select(*[F.col("r")[c].alias(c) if c in rest else F.col(c) for c in history.columns])


class Registry:
    def __init__(self, spark: SparkSession, folder: str, tail_rows: int = 1000) -> None:
        self.spark, self.folder, self.tail_rows = spark, folder.rstrip("/"), tail_rows
        self.versions = Versions(spark, f"{self.folder}/records")

    def _read(self, name: str | None) -> DataFrame:
        if name is None:
            return self.spark.createDataFrame([], RECORDS)
        return self.spark.read.schema(RECORDS).parquet(f"{self.folder}/records/{name}")

    def _written(self, rows: DataFrame, kind: str, files: int = 1) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.coalesce(files).write.parquet(f"{self.folder}/records/{name}")
        return name

    def append(self, rows: DataFrame, expected: int | None = None) -> int:
        """Add changes (RECORDS) as one version. With `expected`, fail where another writer has changed that version; else follow the other."""
        count = rows.count()
        while True:
            number, state = self.versions.latest()
            if expected is not None and number != expected:
                raise Conflict(f"version {number} instead of {expected}")
            new = {"snapshot": state.get("snapshot"), "ids": state.get("ids", 0), "tail_rows": state.get("tail_rows", 0) + count}
            changes = rows if state.get("tail") is None else self._read(state["tail"]).unionByName(rows)
            if new["tail_rows"] > self.tail_rows:
                ids = new["ids"] + new["tail_rows"]  # at most
                new |= {"snapshot": self._written(folded(self._read(new["snapshot"]).unionByName(changes)), "snapshot", -(-ids // FILE_ROWS)), "tail": None, "tail_rows": 0}
                new["ids"] = self._read(new["snapshot"]).count()
            else:
                new["tail"] = self._written(changes, "tail")
            try:
                self.versions.commit(number + 1, new)
                return number + 1
            except Conflict:
                if expected is not None:
                    raise

    def put(self, kind: str, id: str, project_id: str, status: str = "queued", error: str | None = None, location: str | None = None) -> None:
        at = datetime.now(timezone.utc)
        self.append(self.spark.createDataFrame([(kind, id, project_id, status, at, error, location, time.time_ns(), at)], RECORDS))

    def table(self) -> DataFrame:
        """The state of every id: its last row, with the times of its first and last."""
        _, state = self.versions.latest()
        parts = [self._read(state[k]) for k in ("snapshot", "tail") if state.get(k)] or [self._read(None)]
        found = folded(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        return found.withColumnRenamed("at", "updated_at")

    def listed(self, kind: str, limit: int | None = None) -> DataFrame:
        return L.newest_first(self.table().filter(F.col("kind") == kind), limit)

    def state(self, id: str):
        found = self.table().filter(F.col("id") == id).first()
        if found is None:
            raise Missing(id)
        return found

    def ready(self, id: str) -> None:
        found = self.state(id)
        if found["status"] != "ready":
            raise NotReady(f"{id} is {found['status']}")

    def run(self, kind: str, id: str, project_id: str, job: Callable, write: bool = False):
        """queued, running, then ready with the job's result or failed with its error.

        With `write` the job gives tables by name, which are kept for `last`.
        """
        self.put(kind, id, project_id)
        self.put(kind, id, project_id, "running")
        location = None
        try:
            result = job()
            if write:
                location = f"{self.folder}/{kind}/{uuid.uuid4().hex}"
                for name, rows in result.items():
                    rows.write.parquet(f"{location}/{name}")
        except Exception as problem:
            self.put(kind, id, project_id, "failed", str(problem))
            raise
        self.put(kind, id, project_id, "ready", location=location)
        return result

    def last(self, kind: str, project_id: str, name: str) -> DataFrame:
        """A table of the project's last result of that kind; the newest record wins, ready or failed."""
        mine = self.table().filter((F.col("kind") == kind) & (F.col("project_id") == project_id) & F.col("status").isin("ready", "failed"))
        found = mine.orderBy(F.desc("ord")).first()
        if found is None:
            raise Missing(f"{kind} of {project_id}")
        if found["status"] == "failed":
            raise NotReady(f"{kind} of {project_id} failed: {found['error']}")
        return self.spark.read.parquet(f"{found['location']}/{name}")
