"""Near-duplicate documents: MinHash, banding, verification, connected components.

A document's set holds its distinct 2-word shingles (the whole sequence where it has fewer words) as
64-bit hashes. `bands * rows` multiply-add hashes are minimised over the set; bands of `rows` minima are
bucket keys. A pair of similarity s misses every bucket with probability (1 - s^rows)^bands, 1.3e-7
at s = 0.8 with 40 bands of 5.

Copies: documents of equal sets are one class with a number of its own; only classes go on, so a
group of copies costs one row. Classes that share a doc_id are linked from the start. Buckets: no bucket is expanded to all its pairs. First every member
meets the bucket's centre, the member with most bucket mates over all bands (the common source of edited
copies, where there is one); such pairs are verified by signature (`close` is five standard deviations below
the threshold), then on whole sets, and joined to components. Then only buckets that still hold more
than one component are opened, in blocks of bounded size; a block counts all its intersections exactly and
returns the links that join components, fewer than its members. So every pair of a bucket is either in
one component or compared on whole sets.

Null and empty texts, and texts without words, are empty and linked with nothing. Rows with equal ids are one
node and share its links, whatever their texts; rows with a null id are linked with nothing and kept.
Empty tables give no rows. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm.common import batches_of_rows, texts, written
from rootweave.llm.components import components
from rootweave.llm.vocab import slices_of

#: Ids of this many documents, 8 bytes each, may be sent to all tasks.
BROADCAST_IDS = 2_000_000
BLOCK = 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(group: list[str], width: int = 2) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    from xxhash import xxh3_64_intdigest

    out: list[np.ndarray] = []
    for a, b in slices_of(group):
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(group[a:b], pa.large_string())))
        coded = split.flatten().dictionary_encode()
        uniques = coded.dictionary.to_pylist()
        number = np.fromiter(map(xxh3_64_intdigest, uniques), dtype=np.uint64, count=len(uniques)) if uniques else np.zeros(1, np.uint64)
        filled = np.fromiter(map(bool, uniques), dtype=bool, count=len(uniques)) if uniques else np.zeros(1, bool)
        codes = coded.indices.to_numpy()
        kept = filled[codes]
        words = number[codes[kept]]
        starts = np.concatenate([[0], np.cumsum(kept)])[split.offsets.to_numpy()]
        rolled = words
        for j in range(1, width):
            rolled = _mixed(rolled[: len(words) - j] * np.uint64(0x9E3779B97F4A7C15) + words[j:])
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if high - low >= width:
                out.append(np.unique(rolled[low : high - width + 1]))
            elif high > low:  # fewer words than a shingle has: all of them as one
                value = np.array([high - low], dtype=np.uint64)
                for at in range(low, high):
                    value = _mixed(value * np.uint64(3) + words[at : at + 1])
                out.append(value)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


class MinHasher:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 2048):  # bounded memory for long texts
            hashed = x[None, at : at + 2048] * self.a[:, None]
            hashed += self.b[:, None]
            np.minimum(least, hashed.min(axis=1), out=least)
        return least

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A bucket key for each band; the band's number is part of it."""
        value = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in signature.reshape(self.bands, self.rows).T.astype(np.uint64):
            value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + column)
        return value.view(np.int64)


_BASE = "doc_id long, n_shingles long, digest binary, signature binary, keys array<long>"


def _base(batches, hasher: MinHasher, width: int):
    from xxhash import xxh3_128_digest

    for batch in batches:
        for ids, group in batches_of_rows(batch, ["doc_id", "text"], 2048):
            sets = shingle_sets(group, width)
            signatures = [hasher.signature(s) if len(s) else None for s in sets]
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([None if x is None else x.tobytes() for x in signatures], pa.binary()),
                pa.array([None if x is None else hasher.keys(x) for x in signatures], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "signature", "keys"])


def _set_rows(batches, width: int):
    from xxhash import xxh3_128_digest

    for batch in batches:
        for keys, group in batches_of_rows(batch, ["node", "text"], 2048):
            rows = [s.tobytes() for s in shingle_sets(group, width)]
            digests = [xxh3_128_digest(x) for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], names=["node", "digest", "shingles"])


def _close(batches, least: float):
    for batch in batches:
        for a, b, left, right in batches_of_rows(batch, ["a", "b", "left", "right"], 1024):
            x = np.frombuffer(b"".join(left), dtype=np.uint32).reshape(len(a), -1)
            y = np.frombuffer(b"".join(right), dtype=np.uint32).reshape(len(a), -1)
            keep = (x == y).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, dtype=np.int64)[keep], pa.int64()) for v in (a, b)], names=["a", "b"])


def _alike(batches, percent: int):
    for batch in batches:
        for a, b, left, right in batches_of_rows(batch, ["a", "b", "left", "right"], 256):
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(x) + len(y)
                shared = both - len(np.union1d(x, y))
                keep.append(100 * shared >= percent * (both - shared))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, dtype=np.int64)[keep], pa.int64()) for v in (a, b)], names=["a", "b"])


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block, by products of bounded 0/1 matrices."""
    values, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = seen > 1
    column = np.cumsum(common) - 1
    kept = common[inverse]
    row, column = row[kept], column[inverse[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _forest(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components inside one block or two blocks of a bucket, as many as join them and no more."""
    ids, roots = frame["node"].to_numpy(), frame["root"].to_numpy()
    empty = pd.DataFrame({"a": [], "b": []}, dtype="int64")
    if len(frame) < 2 or (roots == roots[0]).all():
        return empty
    sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]]
    sizes = np.array([len(s) for s in sets])
    shared = _shared_counts(sets)
    link = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    link &= roots[:, None] != roots[None, :]
    parent = {r: r for r in roots.tolist()}

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
        x, y = top(roots[i]), top(roots[j])
        if x != y:
            parent[x] = y
            found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64") if found else empty


def _two_sides(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    left = values.select(F.col("node").alias("a"), F.col(column).alias("left"))
    right = values.select(F.col("node").alias("b"), F.col(column).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _sets_of(nodes: DataFrame, classes: DataFrame, repeated: DataFrame, plain: DataFrame, width: int, name: str) -> DataFrame:
    """node, shingles: whole sets of some classes, made again from one document of each.

    Only where a document's id is repeated are sets told apart by their digest and made one.
    """
    many = repeated.select(F.col("doc_id").alias("head"), F.lit(True).alias("many"))
    heads = nodes.join(classes.select("node", "head", "digest"), "node").join(many, "head", "left")
    heads = written(heads.withColumn("many", F.coalesce("many", F.lit(False))), "near-nodes")

    def sets(chosen: DataFrame) -> DataFrame:
        wanted = chosen.select(F.col("head").alias("doc_id"), "node")
        rows = plain.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id").select("node", "text")
        return rows.mapInArrow(partial(_set_rows, width=width), "node long, digest binary, shingles binary")

    found = sets(heads.filter("NOT many")).select("node", "shingles")
    several = heads.filter("many")
    if not several.isEmpty():
        own = several.select("node", "digest")
        found = found.unionByName(sets(several).join(own, ["node", "digest"]).dropDuplicates(["node"]).select("node", "shingles"))
    return written(found, name)


def _repeated(member: DataFrame) -> DataFrame:
    """Ids of several rows, with the least of their classes and the greatest."""
    rows = member.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("z")).filter("n > 1")


def _same_document(member: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links between classes whose documents share an id."""
    ends = repeated.filter("a < z").select("doc_id", "a")
    return ends.join(member.select("doc_id", F.col("node").alias("b")), "doc_id").filter("a < b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 2, bands: int = 40, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for every document."""
    plain = texts(docs)
    deviation = (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    least = percent / 100 - 5 * deviation
    base = written(plain.mapInArrow(partial(_base, hasher=MinHasher(bands, rows), width=width), _BASE), "near-base")
    filled = base.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("head"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")  # numbers stand once written
    heads = filled.join(classes, (filled["digest"] == classes["digest"]) & (filled["doc_id"] == classes["head"])).select("node", "signature", "keys")
    heads = written(heads.dropDuplicates(["node"]), "near-heads")
    member = base.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    member = written(member.select("doc_id", "n_shingles", "node", "head"), "near-members")
    repeated = written(_repeated(member), "near-repeated")

    entries = heads.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = written(entries.join(shared.hint("merge"), "key"), "near-buckets")
    mates = entries.groupBy("node").agg(F.sum("n").alias("mates"))
    centre = entries.join(mates, "node").groupBy("key").agg(F.max_by("node", F.struct("mates", -F.col("node"))).alias("centre"))
    stars = entries.join(centre, "key").filter(F.col("node") != F.col("centre"))
    stars = stars.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    close = written(_two_sides(stars, heads, "signature").mapInArrow(partial(_close, least=least), "a long, b long").distinct(), "near-close")
    sets = _sets_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, repeated, plain, width, "near-sets")
    alike = _two_sides(close, sets, "shingles").mapInArrow(partial(_alike, percent=percent), "a long, b long").distinct()
    links = written(alike.unionByName(_same_document(member, repeated)), "near-links")
    roots = written(components(links), "near-roots")

    labelled = written(entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("key", "n", "node", "root"), "near-labelled")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    open_rows = written(labelled.join(mixed, "key"), "near-open")
    sets = _sets_of(open_rows.select("node").distinct(), classes, repeated, plain, width, "near-sets")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), parts.cast("long")).cast("int")
    blocked = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).join(sets, "node")
    blocked = blocked.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "shingles")
    rest = written(blocked.groupBy("key", "i", "j").applyInPandas(lambda frame: _forest(frame, percent), "a long, b long").distinct(), "near-rest")
    if not rest.isEmpty():
        roots = written(components(links.unionByName(rest)), "near-roots")

    # the least id of a component is the least of its classes' least ids
    least_id = classes.join(roots, "node").groupBy("root").agg(F.min("head").alias("least_id"))
    named = roots.join(least_id, "root").select("node", "least_id")
    component = F.coalesce("least_id", "head", "doc_id")
    found = member.join(named, "node", "left")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
