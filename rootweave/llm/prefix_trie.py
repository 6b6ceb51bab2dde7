"""Conversation prefix trie: one ROLLUP over positional turn columns for all prefixes together.

Turns. A conversation's turns are ordered by `turn` (null first, equal ones by role, then text); null role or text is
empty. Conversation c is rebuilt: the first h turns of conversation c - c % 20 (all if fewer, none if absent), then its own
turns after its first h, h being crc32 of c's decimal digits modulo 4. A turn's id is the MD5 of its role and text.

Blocks. A rebuilt conversation is cut to blocks of eight turns, and each block is a row: conversation, key of the
node that the blocks before it lead to, and eight turn-id columns. The key of a prefix is the sum, modulo the prime
2^61 - 1 and for two hash functions, of hashes of (place, turn id), so keys of all blocks come from running sums, and one
    GROUP BY block, prior node, ROLLUP (t1, ..., t8)
gives the nodes of all depths: grouping_id() says how many columns a row has kept, and rows whose last kept column
is null are no nodes, as their conversations have ended before.

Subtree sums. A node's own saving is booked on its least conversation, at its depth. A subtree's sum is then the sum
over the top's members of what is booked on them from there on, and comes from a second ROLLUP over the conversations that
have bookings, with a suffix sum for every column. Leaves are booked in the same way.

Ends. The ids that end at a node are sorted in bounded chunks, and each node's chunks are hashed in order, as a stream, so
memory is bounded; a SHA-256 over one list is sequential by its nature.

Rows with a null conv_id belong to no conversation and are left out. Repeated rows are turns of their own. A conversation
without any turn left is a member of the root alone. An empty table gives no rows. Long texts are read whole; extra columns
are ignored. No window spans a conversation: a long one is numbered and summed in buckets.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.common import met_by_key, ship, written
from rootweave.operators.ordered import Runs

WIDTH = 8
PRIME = (1 << 61) - 1
#: Ids to a chunk of the lists that are hashed.
CHUNK_BITS = 9
WORD = r"[^\x20\x09-\x0D]+"
_KEYS = ("k1", "k2")


def ordered_turns(table: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn_id, words."""
    rows = table.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    rows = rows.withColumn("_bucket", F.coalesce(F.shiftright("turn", 12), F.lit(-(1 << 62))))
    placed = Runs("conv_id", "_bucket", [F.asc_nulls_first("turn"), "role", "text"]).numbered(rows, "place")
    turn_id = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return placed.select("conv_id", "place", turn_id.alias("turn_id"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, turn_id, words of all rebuilt conversations; conv_id, length of each)."""
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    size = written(size, "trie-sizes")
    own = size.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    of_base = size.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    lead = F.least(F.col("h"), F.coalesce("base_turns", F.lit(0)))
    convs = own.join(of_base, "base", "left").select("conv_id", "n_turns", "base", "h", lead.alias("lead"))
    convs = written(convs.withColumn("length", F.col("lead") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))), "trie-convs")

    heads = turns.filter(F.col("place") < most - 1).withColumnRenamed("conv_id", "base")
    taken = convs.filter("lead > 0").select("conv_id", "base", "lead").join(heads, "base").filter("place < lead")
    total = convs.agg(F.coalesce(F.sum("n_turns"), F.lit(0))).first()[0]
    kept = met_by_key(turns, convs.select("conv_id", "n_turns", "h", "lead"), "conv_id", "n_turns", total).filter("place >= h")
    kept = kept.withColumn("place", F.col("place") - F.col("h") + F.col("lead"))
    columns = ["conv_id", "place", "turn_id", "words"]
    return written(taken.select(*columns).unionByName(kept.select(*columns)), "trie-rebuilt"), convs


def _place_hashes(place: Column, turn_id: Column) -> list[Column]:
    return [F.pmod(h, F.lit(PRIME)) for h in (F.xxhash64(place, turn_id), F.xxhash64(turn_id, F.lit(7), place))]


def _running(blocks: DataFrame, sums: dict[str, str], later: bool = False) -> DataFrame:
    """Add the sums of a conversation's blocks before each block, or after it: {column: new name}."""
    order = F.desc("block") if later else F.asc("block")
    outer = F.desc("_bucket") if later else F.asc("_bucket")
    rows = blocks.withColumn("_bucket", F.shiftright("block", 8))
    totals = rows.groupBy("conv_id", "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    ahead = Window.partitionBy("conv_id").orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "_bucket", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_{c}") for c in sums])
    inside = Window.partitionBy("conv_id", "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(totals, ["conv_id", "_bucket"])
    found = found.withColumns({new: F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, new in sums.items()})
    return found.drop("_bucket", *[f"_{c}" for c in sums])


def turn_blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, block, filled, k1, k2 (prior node), e1, e2 (the node after the block), t1.. and w1..: turn ids and words by place.

    Conversations without turns have an empty block.
    """
    at = F.col("place") % WIDTH
    first, second = _place_hashes(F.col("place"), F.col("turn_id"))
    picked = [F.max(F.when(at == i, F.col(c))).alias(f"{c[0]}{i + 1}") for c in ("turn_id", "words") for i in range(WIDTH)]
    rows = turns.withColumn("block", F.floor(F.col("place") / WIDTH)).withColumns({"_g1": first.cast("decimal(20,0)"), "_g2": second.cast("decimal(20,0)")})
    rows = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("filled"), F.sum("_g1").alias("g1"), F.sum("_g2").alias("g2"), *picked)
    rows = _running(rows, {"g1": "b1", "g2": "b2"})
    key = lambda c: F.pmod(c, F.lit(PRIME).cast("decimal(20,0)")).cast("long")
    rows = rows.withColumns({"k1": key(F.col("b1")), "k2": key(F.col("b2")), "e1": key(F.col("b1") + F.col("g1")), "e2": key(F.col("b2") + F.col("g2"))})
    columns = ["conv_id", "block", "filled", "k1", "k2", "e1", "e2", *[f"{x}{i + 1}" for x in "tw" for i in range(WIDTH)]]
    zero = {c: F.lit(0).cast("long") for c in columns[1:7]}
    none = convs.filter("length = 0").select(*[zero[c].alias(c) if c in zero else F.col(c) if c == "conv_id" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns])
    return written(rows.select(*columns).unionByName(none), "trie-blocks")


def _rolled_up(blocks: DataFrame, measures: str) -> DataFrame:
    """A row for every node with its measures, depth, key and up (its parent's key)."""
    turns = ", ".join(f"t{i + 1}" for i in range(WIDTH))
    found = blocks.sparkSession.sql(f"SELECT block, k1, k2, {turns}, bit_count(grouping_id()) AS rolled, {measures} FROM {{rows}} GROUP BY block, k1, k2, ROLLUP ({turns})", rows=blocks)
    found = found.withColumn("level", F.lit(WIDTH) - F.col("rolled"))
    last = F.array(*[F.col(f"t{i + 1}").isNotNull() for i in range(WIDTH)])
    found = found.filter(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(F.try_element_at(last, F.col("level"))))
    depth = F.col("block") * WIDTH + F.col("level")
    own: list[Column] = [F.col(k) for k in _KEYS]
    above = own
    for i in range(WIDTH):
        hashes = _place_hashes(F.col("block") * WIDTH + i, F.col(f"t{i + 1}"))
        step = [F.when(F.col("level") > i, F.pmod(a + h, F.lit(PRIME))).otherwise(a) for a, h in zip(own, hashes, strict=True)]
        above = [F.when(F.col("level") > i, a).otherwise(b) for a, b in zip(own, above, strict=True)]
        found = found.withColumns({f"_o{i}{j}": x for j, x in enumerate(step)} | {f"_u{i}{j}": x for j, x in enumerate(above)})
        own, above = [F.col(f"_o{i}{j}") for j in range(2)], [F.col(f"_u{i}{j}") for j in range(2)]
    key = F.struct(depth.alias("depth"), own[0].alias("k1"), own[1].alias("k2"))
    up = F.when(depth > 0, F.struct((depth - 1).alias("depth"), above[0].alias("k1"), above[1].alias("k2")))
    kept = [c for c in found.columns if not c.startswith("_") and c not in ("block", "rolled", "k1", "k2") and not (c[0] == "t" and c[1:].isdigit())]
    return found.select(key.alias("key"), up.alias("up"), depth.alias("depth"), *kept)


def _digests(batches):
    """SHA-256 of the joined chunks of every key; chunks of a key follow each other in order."""
    key = state = None
    for batch in batches:
        out: list[tuple] = []
        for *new, text in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")], strict=True):
            if new == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = new, hashlib.sha256()
            state.update(text.encode())
        yield _digest_rows(out)
    if key is not None:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["depth", "k1", "k2", "ends_sha256"])


def ends_of(blocks: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes at which a conversation ends."""
    ends = blocks.groupBy("conv_id").agg(F.max_by(F.struct((F.col("block") * WIDTH + F.col("filled")).alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2")), "block").alias("key"))
    chunks = ends.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))  # 2^CHUNK_BITS ids at most
    chunks = chunks.select("key.*", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = chunks.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "chunk")
    found = dealt.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    return found.select(F.struct("depth", "k1", "k2").alias("key"), "ends_sha256")


def prefix_trie(table: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node."""
    ship(table.sparkSession)
    turns, convs = rebuilt(written(ordered_turns(table), "trie-turns"))
    blocks = turn_blocks(turns, convs)
    words = [f"max(w{i + 1}) AS w{i + 1}" for i in range(WIDTH)]
    nodes = _rolled_up(blocks, ", ".join(["count(*) AS n_convs", "min(conv_id) AS conv_id", *words]))
    last_words = F.when(F.col("level") > 0, F.try_element_at(F.array(*[f"w{i + 1}" for i in range(WIDTH)]), F.col("level"))).otherwise(0)
    nodes = nodes.select("key", "up", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * last_words).alias("saved"))
    nodes = written(nodes, "trie-nodes")
    children = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")

    # what is booked on each conversation, by place; leaves on the whole of it
    at = (F.col("depth") - 1) % WIDTH
    booked = nodes.filter("depth > 0").withColumn("block", F.floor((F.col("depth") - 1) / WIDTH)).groupBy("conv_id", "block")
    booked = booked.agg(*[F.coalesce(F.sum(F.when(at == i, F.col("saved"))), F.lit(0)).alias(f"v{i + 1}") for i in range(WIDTH)])
    leaves = nodes.groupBy("conv_id").agg(F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf"))
    rows = blocks.join(leaves, "conv_id").join(booked, ["conv_id", "block"], "left").drop(*[f"w{i + 1}" for i in range(WIDTH)])
    values = [F.coalesce(f"v{i + 1}", F.lit(0)) for i in range(WIDTH)]
    rows = _running(rows.withColumn("whole", sum(values[1:], values[0])), {"whole": "after"}, later=True)
    from_here = {f"s{i + 1}": sum(values[i + 1 :], values[i]) + F.col("after") for i in range(WIDTH)} | {"s0": F.col("whole") + F.col("after")}
    sums = _rolled_up(rows.withColumns(from_here), ", ".join(["sum(leaf) AS n_leaves", *[f"sum(s{i}) AS s{i}" for i in range(WIDTH + 1)]]))
    saved = F.element_at(F.array(*[f"s{i}" for i in range(WIDTH + 1)]), (F.col("level") + 1).cast("int"))
    sums = sums.select("key", "n_leaves", saved.alias("saved_tokens"))

    parents = nodes.filter("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    below = met_by_key(nodes.filter("up IS NOT NULL"), parents, "up", "_n", nodes.count()).drop("_n")
    root = nodes.filter("up IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = root.unionByName(below).join(sums, "key").join(ends_of(blocks), "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
