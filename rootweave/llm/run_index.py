"""Exact removal of long repeated byte strings with run-length Burrows-Wheeler indexes.

A string of `length` bytes that starts at two places of the corpus contains the same least-hash
`seed`-byte gram at the same offset (leftmost of equals). So each document is cut to stretches: a stretch
spans all windows of `length` bytes that share one such gram. Equal windows meet in stretches of equal
gram hash, and nothing else needs to meet.

1. Every document emits (gram, digest of the stretch, place); no text moves. Grams seen once end here.
2. Stretches of one digest are one class. A class seen twice is repeated as a whole.
3. Grams with several classes are open: one example of each class is cut from its document and sent to a
   block by gram. A block builds a suffix array of its distinct stretches, reduces it to the runs of
   its Burrows-Wheeler transform with text positions sampled at run ends, and drops it. Longest-match
   lengths with either neighbour are computed at run ends only; in between they fall by one for each text
   position, so they are streamed in text order from the samples. Where the longer one reaches `length`,
   a window is repeated.
4. Grams with more than `crowd` classes (the edge of a passage that very many documents hold) would
   outgrow a block. Their windows are parted by where the gram lies in them: those of a range of offsets share a
   longer core around the gram, and equal windows have equal cores. So each range is a gram group of its own
   with a longer seed, again counted, indexed in a block, or parted further while it is crowded;
   a range of one offset holds one window, which is its class.
5. Repeated windows go back to every place of their class; documents drop the bytes that are covered.

Digests have 128 bits. Null and empty texts have no bytes; texts shorter than `length`
lose nothing. Rows are documents: repeated rows repeat each other whatever their ids; null ids are
allowed. Empty tables give no rows. Extra columns are ignored. Long texts are cut in overlapping slices,
which only splits stretches.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.llm.common import batches_of_rows, joined_by_key, shuffle_partitions, texts, written
from rootweave.llm.near_dups import _mixed

#: Places (about 40 bytes each) that may be sent to all tasks; more are joined by shuffles.
BROADCAST_PLACES = 1_000_000
SLICE = 1 << 20
_PLACES = "gram long, digest binary, doc_id long, row_hash long, start long, size int"


def _grams(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the `seed` bytes from every position: a polynomial over prefix sums, then mixed."""
    base = 0x9E3779B97F4A7C15
    inverse = np.uint64(pow(base, -1, 1 << 64))
    n = len(data)
    up = np.full(n, np.uint64(base))
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    down = np.full(n, inverse)
    down[0] = 1
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return _mixed((sums[seed:] - sums[:-seed]) * down[: n - seed + 1])


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def stretches(raw: bytes, ends: np.ndarray, length: int, seed: int):
    """(first, last, gram) of the stretches of texts laid end to end; first and last are window starts."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) < length:
        return []
    hashed = _grams(data, seed)
    bits = np.uint64(22)
    keys = (hashed >> bits << bits) | np.arange(len(hashed), dtype=np.uint64)
    least = _sliding_min(keys, length - seed + 1)
    at = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
    count = len(data) - length + 1
    document = np.searchsorted(ends, np.arange(count), side="right")
    valid = np.arange(count) + length <= ends[document]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return []
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (starts[1:] != starts[:-1] + 1) | (document[starts[1:]] != document[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return zip(starts[first].tolist(), starts[last].tolist(), hashed[at[starts[first]]].view(np.int64).tolist(), document[starts[first]].tolist(), strict=True)


def _places(batches, length: int, seed: int):
    from xxhash import xxh3_128_digest, xxh3_64_intdigest

    def emit(pending, raws):
        raw, ends = b"".join(raws), np.cumsum([len(r) for r in raws])
        begins = ends - [len(r) for r in raws]
        rows: list[list] = [[], [], [], [], [], []]
        for first, last, gram, k in stretches(raw, ends, length, seed):
            doc_id, row_hash, offset = pending[k]
            values = (gram, xxh3_128_digest(raw[first : last + length]), doc_id, row_hash, first - int(begins[k]) + offset, last - first + length)
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["gram", "digest", "doc_id", "row_hash", "start", "size"])

    for batch in batches:
        pending, raws, held = [], [], 0
        for ids, group in batches_of_rows(batch, ["doc_id", "text"], 1024):
            for doc_id, text in zip(ids, group, strict=True):
                raw = text.encode("utf-8")
                if len(raw) < length:
                    continue
                row_hash = xxh3_64_intdigest(raw) - (1 << 63)
                for offset in range(0, len(raw) - length + 1, SLICE):
                    part = raw[offset : offset + SLICE + length - 1]
                    if held + len(part) > SLICE and raws:
                        yield emit(pending, raws)
                        pending, raws, held = [], [], 0
                    pending.append((doc_id, row_hash, offset))
                    raws.append(part)
                    held += len(part)
        if raws:
            yield emit(pending, raws)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Of integers below 2^15 or so, by doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    top = int(symbols.max()) + 2
    depth, key = 1, symbols.astype(np.int64) + 1
    while depth < 4 and top ** (2 * depth) < 1 << 62:
        moved = np.zeros(n, dtype=np.int64)
        moved[:-depth] = key[depth:]
        key = key * top**depth + moved
        depth *= 2
    order = np.argsort(key, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        alone = first & np.append(first[1:], True)
        open_slots = np.flatnonzero(~alone)
        if not len(open_slots):
            return order
        part = order[open_slots]
        second = rank[np.minimum(part + depth, n)]
        key = rank[part] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[open_slots] = part
        new = np.ones(len(part), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first[open_slots] = new
        rank[part] = np.maximum.accumulate(np.where(new, open_slots, 0))
        depth *= 2


class RunIndex:
    """Runs of the Burrows-Wheeler transform of distinct strings, with positions sampled at run ends."""

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) + 1 for s in strings])
        self.data = np.frombuffer(b"".join(s + b"\0" for s in strings), dtype=np.uint8)
        ends = np.cumsum(sizes) - 1  # a separator of its own ends each string
        symbols = self.data.astype(np.int64) + len(strings)
        symbols[ends] = np.arange(len(strings))
        self.left = np.repeat(ends, sizes) - np.arange(len(self.data))  # bytes up to the string's end
        order = suffix_array(symbols)
        before = symbols[order - 1]
        head = np.ones(len(order), dtype=bool)
        head[1:] = before[1:] != before[:-1]
        heads = np.flatnonzero(head)
        self.symbols = before[heads]
        self.lengths = np.diff(np.append(heads, len(order)))
        self.at_head = order[heads]
        self.at_tail = order[np.append(heads[1:], len(order)) - 1]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at a and b, inside their strings."""
        words = np.lib.stride_tricks.sliding_window_view(np.append(self.data, np.zeros(8, np.uint8)), 8)
        most = np.minimum(self.left[a], self.left[b])
        common = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            x, y = a[live] + common[live], b[live] + common[live]
            same = words[x] == words[y]
            run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            common[live] += run
            live = live[(run == 8) & (common[live] < most[live])]
        return np.minimum(common, most)

    def matching_statistics(self) -> np.ndarray:
        """For every text position the longest match that also starts elsewhere, streamed from the samples."""
        n = len(self.data)
        place = np.arange(n)
        out = np.zeros(n, dtype=np.int64)
        if len(self.at_head) > 1:
            border = self._common(self.at_tail[:-1], self.at_head[1:])
        else:
            border = np.zeros(0, dtype=np.int64)
        for sampled, value in ((self.at_head, np.append(0, border)), (self.at_tail, np.append(border, 0))):
            known = np.full(n, -1, dtype=np.int64)
            known[sampled] = value
            source = np.maximum.accumulate(np.where(known >= 0, place, 0))
            np.maximum(out, known[source] - (place - source), out=out)
        return out


def _block_marks(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated windows of the strings of a block, as places in the stretches that they were cut from."""
    strings = frame["bytes"].tolist()
    statistics = RunIndex(strings).matching_statistics()
    repeated = statistics >= length
    rows, at = [], 0
    for digest, single, shift, string in zip(frame["digest"], frame["single"], frame["shift"], strings, strict=True):
        hit = np.flatnonzero(repeated[at : at + len(string)]) + shift
        if single and len(hit):
            cut = np.flatnonzero(np.diff(hit) > 1)
            rows.append((digest, hit[np.append(0, cut + 1)].tolist(), (hit[np.append(cut, len(hit) - 1)] + length).tolist()))
        at += len(string) + 1
    return pd.DataFrame(rows, columns=["digest", "low", "high"])


def _anchor(raw: bytes, length: int, seed: int) -> int:
    """Where the least gram of a stretch begins, as `stretches` chose it."""
    bits = np.uint64(22)
    hashed = _grams(np.frombuffer(raw, dtype=np.uint8)[:length], seed)
    return int((hashed >> bits << bits | np.arange(len(hashed), dtype=np.uint64)).argmin())


_CUT = "gram long, digest binary, single boolean, n_classes long, anchor int, bytes binary"


def _cut(batches, length: int, seed: int, crowd: int):
    """Bytes of places from the texts that they were listed with; for crowded grams, where the gram lies in them."""
    for batch in batches:
        for group, lists in batches_of_rows(batch, ["text", "places"], 256):
            rows = []
            for text, places in zip(group, lists, strict=True):
                raw = text.encode("utf-8")
                for p in places:
                    piece = raw[p["start"] : p["start"] + p["size"]]
                    rows.append((p["gram"], p["digest"], p["single"], p["n_classes"], _anchor(piece, length, seed) if p["n_classes"] > crowd else 0, piece))
            kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["gram", "digest", "single", "n_classes", "anchor", "bytes"])


def _hashed(*parts) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _parted(crowded: DataFrame, length: int, seed: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(marks, rows for blocks) of crowded stretches, by ranges of the gram's offset in a window.

    In a round, every range is parted in four. What has the same bytes in a range is one class: a class of
    several stretches is repeated as a whole, and one stretch stands for it from there on.
    """
    marks, calm = [], []
    level = crowded.select("gram", "digest", "single", "bytes", "anchor", F.lit(0).alias("a"), F.lit(length - seed).alias("b"))
    while True:
        step = F.ceil((F.col("b") - F.col("a") + 1) / 4).cast("int")
        rows = level.withColumn("step", step).withColumn("ca", F.explode(F.sequence("a", "b", "step")))
        rows = rows.withColumn("cb", F.least(F.col("ca") + F.col("step") - 1, F.col("b")))
        low = F.greatest(F.col("anchor") - F.octet_length("bytes") + length, F.col("ca"))
        rows = rows.withColumn("low", low).withColumn("high", F.least("anchor", "cb")).filter("low <= high")
        core = F.substring("bytes", F.col("anchor") - F.col("ca") + 1, length - F.col("cb") + F.col("ca"))
        shift, size = F.col("anchor") - F.col("high"), length + F.col("high") - F.col("low")
        key = _hashed(F.concat_ws(":", "gram", "ca", "cb", F.lit("")).cast("binary"), core)
        rows = rows.select("gram", "digest", "single", "bytes", "anchor", F.col("ca").alias("a"), F.col("cb").alias("b"), key.alias("key"), shift.alias("shift"), size.alias("size"))
        rows = written(rows.withColumn("part", _hashed("key", F.substring("bytes", F.col("shift") + 1, F.col("size")))), "repeat-ranges")
        parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("stands"), F.first("key").alias("k"))
        parts = written(parts, "repeat-parts")
        n_rows, n_parts = rows.count(), parts.count()
        joined = joined_by_key(rows, parts.select("part", "n", "stands"), "part", "n", n_rows)
        marks.append(joined.filter("single AND n > 1").select("digest", F.array("shift").alias("low"), F.array(F.col("shift") + F.col("size")).alias("high")))
        counted = parts.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n_parts")).filter("n_parts > 1")
        standing = joined.filter(F.col("digest") == F.col("stands")).withColumn("single", F.col("single") & (F.col("n") == 1)).drop("n", "stands", "part")
        standing = written(joined_by_key(standing, counted, "key", "n_parts", n_parts), "repeat-standing")
        few = standing.filter(F.col("n_parts") <= crowd)
        calm.append(few.select(F.xxhash64("key").alias("gram"), "digest", "single", "shift", F.substring("bytes", F.col("shift") + 1, F.col("size")).alias("bytes")))
        level = standing.filter(F.col("n_parts") > crowd)
        if level.isEmpty():
            return marks, calm
        level = level.select("gram", "digest", "single", "bytes", "anchor", "a", "b")


def _drop(batches):
    for batch in batches:
        for ids, group, lists in batches_of_rows(batch, ["doc_id", "text", "spans"], 256):
            rows = []
            for doc_id, text, spans in zip(ids, group, lists, strict=True):
                raw = text.encode("utf-8")
                kept, at, removed, runs, end = [], 0, 0, 0, -1
                for span in sorted((s["low"], s["high"]) for s in spans or ()):
                    low, high = span
                    if low > end:
                        runs += 1
                        kept.append(raw[at:low])
                    removed += max(0, high - max(low, at))
                    at = end = max(end, high)
                kept.append(raw[at:])
                rows.append((doc_id, len(raw), removed, runs, b"".join(kept)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_PLACES else df


def without_repeats(docs: DataFrame, length: int = 400, seed: int = 40, crowd: int = 1000, block_bytes: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every document."""
    spark = docs.sparkSession
    plain = texts(docs)
    places = written(plain.mapInArrow(partial(_places, length=length, seed=seed), _PLACES), "repeat-places")
    counted = places.groupBy("gram").agg(F.count(F.lit(1)).alias("places")).filter("places > 1")
    met = written(joined_by_key(places, counted, "gram", "places", places.count()).drop("places"), "repeat-met")
    example = F.min(F.struct("doc_id", "row_hash", "start", "size")).alias("example")
    classes = written(met.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), example), "repeat-classes")
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n_classes")).filter("n_classes > 1")
    open_classes = joined_by_key(classes, several, "gram", "n_classes", classes.count())
    open_classes = written(open_classes.select("gram", "digest", (F.col("n") == 1).alias("single"), "n_classes", "example.*"), "repeat-open")
    sizes = open_classes.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("n_classes").alias("most")).first()

    keyed = plain.mapInArrow(_with_row_hash, "doc_id long, row_hash long, text string")

    def texts_with(chosen: DataFrame, rows: int) -> DataFrame:
        lists = chosen.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("gram", "digest", "single", "n_classes", "start", "size")).alias("places"))
        lists = lists.withColumnRenamed("doc_id", "d").withColumnRenamed("row_hash", "h")
        joined = keyed.join(_small(lists, rows), (F.col("h") == F.col("row_hash")) & F.col("d").eqNullSafe(F.col("doc_id")))
        return joined.dropDuplicates(["d", "h"]).select("text", "places") if rows > BROADCAST_PLACES else joined.select("text", "places")

    blocks = max(shuffle_partitions(spark), -(-int(sizes["bytes"] or 0) // block_bytes))
    cut = texts_with(open_classes, sizes["n"]).mapInArrow(partial(_cut, length=length, seed=seed, crowd=crowd), _CUT).dropDuplicates(["digest"])
    marks = []
    if (sizes["most"] or 0) > crowd:
        cut = written(cut, "repeat-cut")
        marks, calm = _parted(cut.filter(F.col("n_classes") > crowd), length, seed, crowd)
    else:
        calm = []
    calm.append(cut.filter(F.col("n_classes") <= crowd).select("gram", "digest", "single", F.lit(0).alias("shift"), "bytes"))
    blocked = reduce(DataFrame.unionByName, calm).withColumn("block", F.pmod("gram", F.lit(blocks)))
    marks.append(blocked.groupBy("block").applyInPandas(lambda frame: _block_marks(frame, length), "digest binary, low array<int>, high array<int>"))

    # a class seen twice is marked whole at all its places; the others have one place each
    whole = classes.filter("n > 1").select("digest", "n", F.col("example.size").alias("high"))
    spans = joined_by_key(met.select("digest", "doc_id", "row_hash", "start"), whole, "digest", "n", places.count())
    spans = spans.select("doc_id", "row_hash", "start", F.struct(F.lit(0).alias("low"), "high").alias("m"))
    alone = classes.filter("n = 1").select("digest", "example.doc_id", "example.row_hash", "example.start")
    found = alone.join(reduce(DataFrame.unionByName, marks), "digest")
    spans = spans.unionByName(found.select("doc_id", "row_hash", "start", F.explode(F.arrays_zip("low", "high")).alias("m")))
    spans = spans.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct((F.col("start") + F.col("m.low")).alias("low"), (F.col("start") + F.col("m.high")).alias("high"))).alias("spans"))
    spans = written(spans, "repeat-spans").withColumnRenamed("doc_id", "d").withColumnRenamed("row_hash", "h")
    # a sort-merge join: texts move once, however few documents lose bytes
    final = keyed.join(spans.hint("merge"), (F.col("h") == F.col("row_hash")) & F.col("d").eqNullSafe(F.col("doc_id")), "left")
    return final.select("doc_id", "text", "spans").mapInArrow(_drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _with_row_hash(batches):
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        for ids, group in batches_of_rows(batch, ["doc_id", "text"], 1024):
            hashed = [xxh3_64_intdigest(t.encode("utf-8")) - (1 << 63) for t in group]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashed, pa.int64()), pa.array(group, pa.string())], names=["doc_id", "row_hash", "text"])
