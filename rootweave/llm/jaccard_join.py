"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document's set holds the 64-bit hashes of its distinct 4-word shingles (the whole sequence where it has
fewer words). Two sets link when 100 * intersection >= percent * union; no link is missed.

Bands. Sizes are cut to bands whose ends differ by the factor 100 / percent, so a set of size n can
only link with smaller ones of its own band and of the one that holds percent * n / 100. It is listed in these two.

Tiles. Linked sets of a band differ in at most k shingles, k following from the band's sizes. The range of
hashes is cut to more than k parts, so a linked pair agrees on a whole part: (band, part, hash of the part's
shingles) is the key of a tile, and only sets of one tile are compared. Some of the parts that agree may be
empty ones, so there are spare parts, and a set with too many empty ones is listed under those too.

Inside a tile. Every set has a bitmap of the parity of its hashes' low bits, four to eight bits for each shingle. The
bits that differ between two bitmaps are at most the shingles that differ, so their count bounds the
intersection from above; only pairs whose bound reaches the threshold are intersected, as sorted arrays.

Classes and groups. Documents of equal sets are one class and cost one row. Members of a tile first meet
only its centre, the one that has most tile mates; links found so are joined to components, and only tiles that
still hold several components are opened, in blocks of at most 1,024 members and about 8 MB. Bitmaps of all pairs of
a block are compared, and pairs within the bound are presumed to link: a block returns those that join its components,
fewer than its members, and these are intersected. Where a presumption was wrong, members that still have a partner
within the bound in another component meet once more, as whole sets. So no tile is expanded to its pairs, and each pair of a
tile ends in one component, beyond the bound, or intersected.

Null and empty texts, and texts without words, are empty and linked with nothing. Rows with equal ids are one
node and share its links, whatever their texts; rows with a null id are linked with nothing and kept, with a null
component. Empty tables give no rows; repeated rows are rows; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootweave.llm.common import batches_of_rows, met_by_key, texts, written
from rootweave.llm.components import components
from rootweave.llm.near_dups import BROADCAST_IDS, _mixed, _repeated, _same_document, _sets_of, _two_sides, shingle_sets

BLOCK, BLOCK_BYTES = 1024, 8_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """Least size of every band."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows, dtype=np.int64)


def band_of(size: int, percent: int) -> int:
    return int(np.searchsorted(bands(percent), size, side="right")) - 1


def differing(band: int, percent: int) -> int:
    """Most shingles in which two linked sets differ, the smaller of them in this band."""
    small = int(bands(percent)[band + 1]) - 1
    return (small + small * 100 // percent) * (100 - percent) // (100 + percent)


def tile_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles of a sorted set; none where only equal sets link."""
    size = len(shingles)
    found = [np.zeros(0, np.uint64)]
    for band in {band_of(size, percent), band_of(-(-size * percent // 100), percent)} if size else ():
        most = differing(band, percent)
        if not most:
            continue
        parts = most + 2 + most // 32
        # hashes ascend, so those of a part are neighbours
        part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        total = np.zeros(parts, np.uint64)
        total[part[first].astype(np.int64)] = np.add.reduceat(_mixed(shingles), first)
        key = _mixed(_mixed(total) + (np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)) * _STEP)
        found.append(key[part[first].astype(np.int64)] if len(first) > most else key)
    return np.concatenate(found).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """Size, then the bitmap: the parity of the hashes on each value of their low bits."""
    width = max(128, 4 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.int64(len(shingles)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def unpacked(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and a row of words for each bitmap; wider bitmaps are folded to the narrowest."""
    sizes = np.array([int.from_bytes(s[:8], "little") for s in sketches], dtype=np.int64)
    words = min(map(len, sketches)) // 8 - 1
    maps = [np.frombuffer(s, dtype=np.uint64, offset=8).reshape(-1, words) for s in sketches]
    return sizes, np.array([np.bitwise_xor.reduce(m, axis=0) for m in maps], dtype=np.uint64)


def needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of two linked sets, by the sum of their sizes."""
    return -(-percent * sizes // (100 + percent))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


_BASE = "doc_id long, n_shingles long, n_keys long, digest binary, sketch binary, keys array<long>"


def _base(batches, percent: int, width: int):
    from xxhash import xxh3_128_digest

    for batch in batches:
        for ids, group in batches_of_rows(batch, ["doc_id", "text"], 512):
            sets = shingle_sets(group, width)
            keys = [tile_keys(s, percent) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            columns = [
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.diff(ends), pa.int64()),
                pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "n_keys", "digest", "sketch", "keys"])


def _within_bound(batches, percent: int):
    """Pairs whose bitmaps leave room for a link."""
    for batch in batches:
        for a, b, left, right in batches_of_rows(batch, ["a", "b", "left", "right"], 1024):
            keep = []
            for pair in zip(left, right, strict=True):
                sizes, maps = unpacked(list(pair))
                apart = int(np.bitwise_count(maps[0] ^ maps[1]).sum())
                keep.append((sizes.sum() - apart) // 2 >= needed(sizes.sum(), percent) <= sizes.min())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, dtype=np.int64)[np.array(keep, dtype=bool)], pa.int64()) for v in (a, b)], names=["a", "b"])


def _linked(batches, percent: int):
    """Pairs whose sets link."""
    for batch in batches:
        for a, b, left, right in batches_of_rows(batch, ["a", "b", "left", "right"], 256):
            keep = np.zeros(len(a), dtype=bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                keep[i] = shared(x, y) >= needed(len(x) + len(y), percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, dtype=np.int64)[keep], pa.int64()) for v in (a, b)], names=["a", "b"])


def _tiles(batches):
    """Rows of one block, or of two blocks of a tile, at a time; they follow each other, across batches too."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if held and tuple(names[low]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(names[low])
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


class _Block:
    """Members of one block, or of two blocks of a tile; `label` names their components."""

    def __init__(self, rows: pa.Table, percent: int):
        self.nodes, self.own, roots = (rows.column(c).to_numpy() for c in ("node", "own", "root"))
        self.percent = percent
        self.label = np.unique(roots, return_inverse=True)[1]
        self.across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        self.sizes, self.maps = unpacked(rows.column("sketch").to_pylist())

    def partners(self, i: int) -> np.ndarray:
        """Later members of other components whose bitmaps leave room for a link; across blocks, of the other block."""
        both = self.sizes[i] + self.sizes[i + 1 :]
        need = needed(both, self.percent)
        apart = np.bitwise_count(self.maps[i + 1 :] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
        near = ((both - apart) // 2 >= need) & (need <= np.minimum(self.sizes[i], self.sizes[i + 1 :])) & (self.label[i + 1 :] != self.label[i])
        if self.across:
            near &= self.own[i + 1 :] != self.own[i]
        return np.flatnonzero(near) + i + 1

    def joined(self, links=None) -> list[tuple[int, int]]:
        """Pairs within the bound that `links(i, j)` holds for, as many as join components and no more."""
        found = []
        for i in range(len(self.nodes) - 1):
            for j in self.partners(i).tolist():
                if self.label[i] != self.label[j] and (links is None or links(i, j)):
                    found.append((min(self.nodes[i], self.nodes[j]), max(self.nodes[i], self.nodes[j])))
                    self.label[self.label == self.label[j]] = self.label[i]
        return found

    def undecided(self) -> np.ndarray:
        """Members with a partner within the bound in another component."""
        open_ = np.zeros(len(self.nodes), dtype=bool)
        for i in range(len(self.nodes) - 1):
            partners = self.partners(i)
            open_[partners] = True
            open_[i] |= len(partners) > 0
        return self.nodes[open_]


def _rows(found, names: list[str], size: int = 10_000):
    """Pairs as record batches."""
    held: list[tuple[int, int]] = []
    for pairs in found:
        held += pairs
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)
            held = []
    columns = list(zip(*held, strict=True)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _presumed(batches, percent: int):
    return _rows((_Block(rows, percent).joined() for rows in _tiles(batches)), ["a", "b"])


def _undecided(batches, percent: int):
    return _rows(([(rows.column("key")[0].as_py(), node) for node in _Block(rows, percent).undecided()] for rows in _tiles(batches)), ["key", "node"])


def _compared(batches, percent: int):
    def links(rows: pa.Table) -> list[tuple[int, int]]:
        block = _Block(rows, percent)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
        return block.joined(lambda i, j: shared(sets[i], sets[j]) >= needed(block.sizes[i] + block.sizes[j], percent))

    return _rows(map(links, _tiles(batches)), ["a", "b"])


def _by_tile(rows: DataFrame, kernel, percent: int, schema: str) -> DataFrame:
    """The kernel over the blocks of all tiles, many in a task."""
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(partial(kernel, percent=percent), schema).distinct()


def _opened(tiles: DataFrame, roots: DataFrame, heads: DataFrame, total: int, weight: int) -> DataFrame:
    """key, i, j, own, node, root: members of the tiles that hold several components, dealt to blocks; a shingle weighs `weight` bytes."""
    labelled = tiles.join(roots, "node", "left").join(heads.select("node", "n_shingles"), "node").withColumn("root", F.coalesce("root", "node"))
    labelled = written(labelled.select("key", "node", "root", "n_shingles"), "join-labelled")
    members = [F.sum(h.cast("decimal(20,0)")).alias(name) for name, h in (("m1", F.xxhash64("node")), ("m2", F.xxhash64(F.lit(1), "node")))]
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"), *members)
    # tiles of the same members are one
    mixed = mixed.filter("low < high").groupBy("n", "m1", "m2").agg(F.min("key").alias("key"), F.max("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(weight * F.col("size") / BLOCK_BYTES)).cast("int")
    mixed = written(mixed.select("key", "n", blocks.alias("blocks")), "join-mixed")
    rows = met_by_key(labelled.select("key", "node", "root"), mixed, "key", "n", total)
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks").cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")


def jaccard_components(docs: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for every document."""
    plain = texts(docs)
    base = plain.mapInArrow(partial(_base, percent=percent, width=width), _BASE)
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "join-base")  # numbers stand once written
    filled = base.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("h"))
    classes = written(classes.select("digest", F.col("h.doc_id").alias("head"), F.col("h.row").alias("node")), "join-classes")
    member = base.select("doc_id", "n_shingles", "row", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    member = written(member.select("doc_id", "n_shingles", "row", "node", "head"), "join-members")
    repeated = written(_repeated(member), "join-repeated")
    copies = member.filter("row <> node").select("row")
    heads = filled.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "row", "left_anti").withColumnRenamed("row", "node")

    # tiles of several sets, and the links of their members to their centres
    listed = heads.select("node", F.explode("keys").alias("key"))
    total = heads.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    several = written(listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "join-several")
    tiles = written(met_by_key(listed, several, "key", "n", total), "join-tiles")
    mates = tiles.groupBy("node").agg(F.sum("n").alias("mates"))
    centre = tiles.join(mates, "node").groupBy("key", "n").agg(F.max_by("node", F.struct("mates", -F.col("node"))).alias("centre"))
    centre = written(centre.withColumnRenamed("n", "held"), "join-centres")
    tiles = tiles.select("node", "key")
    stars = met_by_key(tiles, centre, "key", "held", total).filter(F.col("node") != F.col("centre"))
    stars = stars.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    close = _two_sides(stars, heads, "sketch").mapInArrow(partial(_within_bound, percent=percent), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs whose whole sets link."""
        pairs = written(pairs, "join-pairs")
        sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, repeated, plain, width, "join-sets")
        return _two_sides(pairs, sets, "shingles").mapInArrow(partial(_linked, percent=percent), "a long, b long")

    links = written(confirmed(close).unionByName(_same_document(member, repeated)), "join-links")
    roots = written(components(links), "join-roots")

    # tiles that still hold several components are opened
    sketches = heads.select("node", "sketch")
    blocked = _opened(tiles, roots, heads, total, 1).join(sketches, "node")
    presumed = _by_tile(blocked, _presumed, percent, "a long, b long")
    more = written(confirmed(presumed), "join-more")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = written(components(links), "join-roots")
        blocked = _opened(tiles, roots, heads, total, 1).join(sketches, "node")
    undecided = written(_by_tile(blocked, _undecided, percent, "key long, node long"), "join-undecided")
    if not undecided.isEmpty():
        sets = _sets_of(undecided.select("node").distinct(), classes, repeated, plain, width, "join-sets")
        whole = _opened(undecided.select("node", "key"), roots, heads, total, 8).join(sketches, "node").join(sets, "node")
        rest = written(_by_tile(whole, _compared, percent, "a long, b long"), "join-rest")
        if not rest.isEmpty():
            roots = written(components(links.unionByName(rest)), "join-roots")

    # the least id of a component is the least of its classes' least ids
    least_id = classes.join(roots, "node").groupBy("root").agg(F.min("head").alias("least_id"))
    named = roots.join(least_id, "root").select("node", "least_id")
    return member.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("least_id", "head", "doc_id").alias("component_id"))
