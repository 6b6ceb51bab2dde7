"""Mixture-controlled packing by deficit round-robin over source queues.

Documents are dealt to bins by a hash of id and place in the input, so every bin draws on all sources; a hot
source, id or text is spread over all bins. In a bin each source has a queue of documents. Every window takes
turns: a source is owed its target share of each token packed; for a window every non-empty queue
earns its share, and the most underpaid one sends what it is owed, a quantum of `size / 16` tokens at least,
until the window holds `size` tokens. Credit or debt that is left is carried to the next window, and
the credit of all earlier bins (what their mixture owed less what they held) opens the next bin.
Documents are cut at window ends, so only a bin's last window is short; it is split at powers of
two, which need no padding. Sequence numbers run on from bin to bin without gaps.

The default target is the corpus's own proportion of tokens. Null text is empty and gives the end
id alone; a null source is a queue of its own; rows with equal or null ids each keep their own pieces
(ordered by length and checksum). A very long text is cut like any other; its bin is as large as it is.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.common import shuffle_partitions, ship, written
from rootweave.llm.vocab import batch_slices
from rootweave.llm.vocab import encoder as encoder_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _tokenise(batches, path: str, end_id: int):
    encoder = encoder_of(path)
    for batch in batches:
        for part in batch_slices(batch):
            ids, counts = encoder.encode(part.column("text"), end_id)
            chars = pc.utf8_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("place", "doc_id", "source")), chars, pa.array(counts), ids], names=["place", "doc_id", "source", "n_chars", "n_tokens", "ids"])


def deficit_round_robin(queues: dict, share: dict, credit: dict, size: int, quantum: int = 1):
    """Yield (window, key, take) turns until all queues are empty.

    queues: key -> deque of document lengths; share: key -> target proportion; credit: key -> tokens owed
    at the start, updated in place. A turn sends at least `quantum` tokens where the queue and the window
    have them, so a window is cut to few pieces and no key is ahead by more than that.
    """
    left = {k: sum(q) for k, q in queues.items()}
    window = 0
    while left := {k: n for k, n in left.items() if n}:
        room = min(size, sum(left.values()))
        weight = sum(share[k] for k in left)
        for k in left:
            credit[k] += room * (share[k] / weight if weight else 1 / len(left))
        while room:
            k = max((k for k, n in left.items() if n), key=credit.__getitem__)
            take = min(room, left[k], max(quantum, round(credit[k])))
            credit[k] -= take
            left[k] -= take
            room -= take
            yield window, k, take
        window += 1


def _spans(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences of a bin: full windows, then powers of two."""
    spans = [(at, size) for at in range(0, total - total % size, size)]
    at, rest = total - total % size, total % size
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            spans.append((at, 1 << bit))
            at += 1 << bit
    return spans


def _fill(frame: pd.DataFrame, opening: pd.DataFrame, size: int, width: int) -> pd.DataFrame:
    if frame.empty:
        return pd.DataFrame({c.split()[0]: [] for c in PIECES.split(", ")})
    frame = frame.assign(crc=[zlib.crc32(x) for x in frame["ids"]])
    frame = frame.sort_values(["source_key", "doc_id", "n_tokens", "crc"], kind="stable", na_position="first").reset_index(drop=True)
    keys = frame["source_key"].to_numpy()
    queues = {k: deque(frame["n_tokens"][keys == k]) for k in dict.fromkeys(keys)}
    rows = {k: deque(np.flatnonzero(keys == k)) for k in queues}
    credit = dict(zip(opening["source_key"], opening["owed"], strict=True))
    share = dict(zip(opening["source_key"], opening["share"], strict=True))
    starts = np.zeros(len(frame), dtype=np.int64)
    spans = _spans(int(frame["n_tokens"].sum()), size)
    ids, lengths, doc_ids = frame["ids"].to_numpy(), frame["n_tokens"].to_numpy(), frame["doc_id"].to_numpy()
    out, sequence, offset = [], 0, 0
    for _, key, take in deficit_round_robin(queues, share, credit, size, max(1, size // 16)):
        while take:
            row = rows[key][0]
            n = int(min(take, lengths[row] - starts[row], spans[sequence][1] - offset))
            part = np.frombuffer(ids[row], dtype=f"<u{width}", count=n, offset=int(starts[row]) * width).astype("<u4")
            last = out[-1] if out else None
            if last and last[0] == row and last[3] == sequence:  # the same document goes on
                last[2] += n
                last[5] = zlib.crc32(part, last[5])
            else:
                out.append([row, int(starts[row]), n, sequence, offset, zlib.crc32(part)])
            starts[row] += n
            take -= n
            offset += n
            if starts[row] == lengths[row]:
                rows[key].popleft()
            if offset == spans[sequence][1]:
                sequence, offset = sequence + 1, 0
    table = np.array([x[:5] for x in out], dtype=np.int64).reshape(-1, 5)
    at = table[:, 0]
    return pd.DataFrame(
        {
            "doc_id": pd.array(doc_ids[at], dtype="Int64"), "start": table[:, 1], "length": table[:, 2], "ids_crc32": np.array([x[5] for x in out], dtype=np.int64),
            "doc_tokens": lengths[at], "sequence_id": table[:, 3] + int(opening["base"].iloc[0]), "offset": table[:, 4], "source": frame["source"].to_numpy()[at],
        }
    )


def _before(rows: DataFrame, keys: list[str], values: dict[str, str], per_group: int = 4096) -> DataFrame:
    """The rows with sums of columns over the earlier bins of their keys.

    Bins are summed in groups first, so no task holds more than a group of bins, or one row for each group.
    """
    grouped = rows.withColumn("group", F.floor(F.col("bin") / per_group))
    totals = grouped.groupBy(*keys, "group").agg(*[F.sum(c).alias(f"total_{c}") for c in values])
    over_groups = Window.partitionBy(*keys).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "group", *[F.coalesce(F.sum(f"total_{c}").over(over_groups), F.lit(0)).alias(f"before_{c}") for c in values])
    inside = Window.partitionBy(*keys, "group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    found = grouped.join(totals, [*keys, "group"])
    return found.select(*rows.columns, *[(F.col(f"before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for c, name in values.items()])


def _shares(per_bin: DataFrame, target: dict | None) -> DataFrame:
    """source_key, share: a row for each source."""
    weight = F.sum("n").cast("double")
    if target is not None:
        wanted = F.create_map(*[F.lit(x) for k, v in target.items() for x in ("" if k is None else f"={k}", float(v))]) if target else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(wanted, F.col("source_key")), F.lit(0.0))
    by_source = per_bin.groupBy("source_key").agg(weight.alias("weight"))
    total = by_source.agg(F.sum("weight")).scalar()
    return by_source.select("source_key", F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0)).alias("share"))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048, target: dict | None = None, bin_chars: int = 4_000_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    `target`: source -> weight; sources that it lacks get weight 0 and fill windows only when the
    others have run dry. `bin_chars` bounds what one task holds; a bin is at least one document.
    """
    from tokenizers import Tokenizer

    ship(docs.sparkSession)
    spark = docs.sparkSession
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4
    placed = plain.withColumn("place", F.monotonically_increasing_id())  # tells equal rows apart; the written spool fixes it
    spool = written(placed.mapInArrow(partial(_tokenise, path=vocabulary, end_id=end_id), "place long, doc_id long, source string, n_chars long, n_tokens long, ids binary"), "packing-spool")
    bins = max(1, -(-(spool.agg(F.sum(F.col("n_chars") + 1)).first()[0] or 0) // bin_chars))
    spool = spool.withColumn("bin", F.pmod(F.xxhash64("doc_id", "place"), F.lit(bins)).cast("int")).drop("place", "n_chars")
    spool = spool.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    per_bin = written(spool.groupBy("bin", "source_key").agg(F.sum("n_tokens").alias("n")), "packing-counts")

    sizes = per_bin.groupBy("bin").agg(F.sum("n").alias("n_bin"))
    sizes = sizes.withColumn("sequences", (F.col("n_bin") / size).cast("long") + F.bit_count(F.col("n_bin") % size))
    bases = _before(sizes, [], {"sequences": "base", "n_bin": "packed"}).select("bin", "base", "packed")
    held = _before(per_bin, ["source_key"], {"n": "held"})
    opening = held.join(bases, "bin").join(_shares(per_bin, target), "source_key")
    opening = opening.select("bin", "base", "source_key", "share", (F.col("share") * F.col("packed") - F.col("held")).alias("owed"))
    return spool.groupBy("bin").cogroup(opening.groupBy("bin")).applyInPandas(lambda frame, opening: _fill(frame, opening, size, width), PIECES)
