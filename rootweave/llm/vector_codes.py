"""Vector code compression: integer product quantisation with memoised grid cells.

Vectors become integers floor(256 * x) and are cut to `parts` equal consecutive parts. Each part position has
a codebook of up to `entries` entries: first the parts of the least vec_ids, then, in every round, the
componentwise floored means of the parts assigned to each entry; unused entries stay.

Assignment. Space is cut to boxes whose side is a power of two, about an eighth of the codebook's range. A part's
box is hashed, and the memo holds for every box met so far those entries that can be nearest
somewhere in it: an entry whose least distance to the box is above another one's greatest is dominated and left
out, equals stay. Only the remaining ones are evaluated, exactly, ties going to the lower index. Boxes of
equal hashes are told apart by their coordinates. A memo of more than `MEMO` boxes starts again, which
costs time and changes nothing.

Spark deals the vectors; each task adds its parts up for each entry, so a round sends `parts * entries`
sums a task and the driver holds codebooks alone, whatever the number of vectors. Vectors are not shuffled.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of several lengths are filled
up with zeros to the greatest, and that to a multiple of `parts`, so an empty vector is one of zeros. Integers beyond +-2^22
(components beyond 16,384) count as these ends. Equal vec_ids are ordered by their vectors, null ids come
last; repeated rows are rows, each with its own result. Fewer kept rows than entries give smaller codebooks, none an
empty result. Null labels are one label. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.llm.common import met_by_key, ship, written

SCALE, LIMIT, MEMO, ROWS = 256, 1 << 22, 1 << 16, 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Grid:
    """One part position: nearest entries, by box."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        reach = int((entries.max(axis=0) - entries.min(axis=0)).max(initial=0)) if len(entries) else 0
        self.shift = max(reach // 8, 1).bit_length() - 1
        self.evaluated = 0
        self.forget()

    def forget(self) -> None:
        width = self.entries.shape[1]
        self.slot: dict[int, int] = {}
        self.boxes = np.zeros((0, width), np.int64)
        self.starts, self.counts, self.able = (np.zeros(0, np.int64) for _ in range(3))

    def undominated(self, boxes: np.ndarray) -> np.ndarray:
        """Which entries (columns) can be nearest to some point of each box (rows)."""
        low = boxes << self.shift
        high = low + (1 << self.shift) - 1
        near, far = (np.zeros((len(boxes), len(self.entries)), np.int64) for _ in range(2))
        for j in range(boxes.shape[1]):
            e = self.entries[None, :, j]
            below, above = low[:, j : j + 1] - e, e - high[:, j : j + 1]
            near += np.maximum(np.maximum(below, above), 0) ** 2
            far += np.maximum(np.abs(e - low[:, j : j + 1]), np.abs(e - high[:, j : j + 1])) ** 2
        return near <= far.min(axis=1, keepdims=True)

    def _remember(self, keys: np.ndarray, boxes: np.ndarray) -> None:
        if len(self.slot) + len(keys) > MEMO:
            self.forget()
        held = len(self.slot)
        rows, able = np.nonzero(self.undominated(boxes))
        counts = np.bincount(rows, minlength=len(boxes))
        self.starts = np.concatenate([self.starts, len(self.able) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.able = np.concatenate([self.able, able])
        self.boxes = np.concatenate([self.boxes, boxes])
        self.slot.update(zip(keys.tolist(), range(held, held + len(keys)), strict=True))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance, for at most MEMO points."""
        boxes = points >> self.shift
        keys = np.zeros(len(points), np.uint64)
        for j in range(points.shape[1]):
            keys = (keys ^ boxes[:, j].astype(np.uint64)) * _STEP
            keys ^= keys >> np.uint64(29)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = unique.tolist()
        new = [i for i, k in enumerate(names) if k not in self.slot]
        if new and len(self.slot) + len(new) > MEMO:
            self.forget()
            new = list(range(len(names)))
        if new:
            self._remember(unique[new], boxes[first[new]])
        slots = np.array([self.slot[k] for k in names], dtype=np.int64)[inverse]
        able = (self.boxes[slots] == boxes).all(axis=1)
        index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        known = np.flatnonzero(able)
        if len(known):
            counts = self.counts[slots[known]]
            ends = np.cumsum(counts)
            ramp = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
            index[known], distance[known] = self._least(points[known], self.able[np.repeat(self.starts[slots[known]], counts) + ramp], counts)
        for i in np.flatnonzero(~able).tolist():  # another box of the same hash
            index[i : i + 1], distance[i : i + 1] = self._least(points[i : i + 1], np.arange(len(self.entries)), np.array([len(self.entries)]))
        return index, distance

    def _least(self, points: np.ndarray, able: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best of each point's entries, which follow each other in `able`."""
        self.evaluated += len(able)
        apart = np.zeros(len(able), np.int64)
        for j in range(points.shape[1]):
            apart += (np.repeat(points[:, j], counts) - self.entries[able, j]) ** 2
        best = np.minimum.reduceat(apart * len(self.entries) + able, np.cumsum(counts) - counts)
        return best % len(self.entries), best // len(self.entries)


def integers(column: pa.Array, length: int) -> np.ndarray:
    """A row of `length` integers for each vector."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(np.clip(column.flatten().to_numpy(zero_copy_only=False) * SCALE, -LIMIT, LIMIT)).astype(np.int64)
    if (sizes == length).all():
        return flat.reshape(-1, length)
    out = np.zeros((len(sizes), length), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _slices(batches, codebooks: np.ndarray):
    """(rows of a batch, index and distance of each of their parts, the parts)."""
    parts, _, width = codebooks.shape
    grids = [Grid(book) for book in codebooks]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            points = integers(rows.column("vector"), parts * width).reshape(-1, parts, width)
            found = [grid.nearest(np.ascontiguousarray(points[:, p])) for p, grid in enumerate(grids)]
            yield rows, np.array([f[0] for f in found]), np.array([f[1] for f in found]), points


def _sums(batches, codebooks: np.ndarray):
    """One row for each entry that the task's parts went to."""
    parts, entries, width = codebooks.shape
    n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for _, index, _, points in _slices(batches, codebooks):
        for p in range(parts):
            order = np.argsort(index[p], kind="stable")
            used, first, count = np.unique(index[p][order], return_index=True, return_counts=True)
            n[p, used] += count
            total[p, used] += np.add.reduceat(points[order, p], first)
    part, entry = np.nonzero(n)
    sums = [pa.array(total[part, entry, j], pa.int64()) for j in range(width)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int64()), pa.array(entry, pa.int64()), pa.array(n[part, entry], pa.int64()), *sums], names=["part", "entry", "n", *[f"s{j}" for j in range(width)]]
    )


def _coded(batches, codebooks: np.ndarray):
    for rows, index, distance, _ in _slices(batches, codebooks):
        digits = [bytes(code).hex() for code in index.T.astype(np.uint8)]
        columns = [rows.column("vec_id"), rows.column("label"), pa.array(digits, pa.string()), pa.array(distance.sum(axis=0), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])


def kept_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector (doubles) of the rows whose vectors have finite components alone."""
    values = F.col(vector).cast("array<double>")
    found = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), values.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return found.filter(F.col("vector").isNotNull() & finite)


def codebooks_of(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Integers by part, entry and position; nothing without vectors."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = max(-(-longest // parts), 1)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()  # as many rows as entries
    seeds = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), parts * width)
    books = np.ascontiguousarray(seeds.reshape(-1, parts, width).transpose(1, 0, 2))
    names = [f"s{j}" for j in range(width)]
    schema = "part long, entry long, n long, " + ", ".join(f"{s} long" for s in names)
    for _ in range(rounds):
        sums = kept.select("vector").mapInArrow(partial(_sums, codebooks=books), schema).groupBy("part", "entry")
        found = sums.agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect()  # parts * entries rows at most
        books = books.copy()
        for row in found:
            books[row["part"], row["entry"]] = [row[s] // row["n"] for s in names]
    return books


def printed(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def vector_codes(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so a codebook has 1 to 256 entries")
    spark = table.sparkSession
    ship(spark)
    kept = kept_vectors(table)
    books = codebooks_of(kept, parts, entries, rounds)
    kind = kept.schema["label"].dataType.simpleString()
    if books is None:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(kept.mapInArrow(partial(_coded, codebooks=books), f"vec_id long, label {kind}, code string, error long"), "vector-codes")
    coded = coded.withColumn("_key", _key(F.col("label")))
    totals = coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    found = met_by_key(coded, written(totals, "vector-labels"), "_key", "_n", coded.count())
    digest = hashlib.sha256(printed(books).encode()).hexdigest()
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _key(label: Column) -> Column:
    """Labels as text, so that null is a key too."""
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))
