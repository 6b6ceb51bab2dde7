"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

An id is replaced by its rank in the corpus (0: the most frequent) and stored in 1 to 4 whole
bytes, low byte first. Lengths stand apart from the data: one control byte holds the lengths less
one of four ids, two bits each, first id lowest. Decoding looks every control byte up in a table of
four lengths, sums them to offsets and gathers the bytes with numpy; no branch per id.

A file is a Parquet part of rows (part, doc_id, start, n_tokens, control, data) in ascending doc_id
order; `start` counts the ids of the rows before it in its part, and ascending part numbers hold ascending
doc_ids. The rank table is written beside the parts.

Null and empty texts hold the end id alone. Rows with a null doc_id come first; rows with equal
doc_ids all stay, in an order of their ids, and may fill several parts. Very long texts are one row; a
slice of texts holds less than 2 GB of ids. Empty tables give an empty file set. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootweave.llm.common import scratch_path, shuffle_partitions, texts, written
from rootweave.llm.vocab import batch_slices
from rootweave.llm.vocab import encoder as encoder_of

_SHIFTS = np.arange(0, 8, 2, dtype=np.uint8)
#: Lengths of the four ids of every control byte.
LENGTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> _SHIFTS) & 3).astype(np.int64) + 1
FILE_SCHEMA = "part int, doc_id long, start long, n_tokens long, control binary, data binary"


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code[: len(ranks)] = size - 1
    control = np.bitwise_or.reduce(code.reshape(-1, 4) << _SHIFTS, axis=1).astype(np.uint8)
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    first = np.cumsum(size) - size
    raw = np.zeros(len(data) + 3, dtype=np.uint8)
    raw[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    out = raw[first].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(size > k)
        if not len(long):
            break
        out[long] |= raw[first[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def numbers_of(column: pa.Array, width: int) -> np.ndarray:
    """The numbers of all rows of a binary column, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    return np.frombuffer(column.buffers()[2] or b"", dtype=f"<u{width}", count=int(offsets[-1] - offsets[0]) // width, offset=int(offsets[0])) if offsets[-1] else np.zeros(0, f"<u{width}")


def _tokenise(batches, path: str, end_id: int):
    encoder = encoder_of(path)
    for batch in batches:
        for part in batch_slices(batch):
            ids, _ = encoder.encode(part.column("text"), end_id)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])


def token_ids(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian, two bytes each; four for vocabularies over 65,536), end id last."""
    return texts(docs).mapInArrow(partial(_tokenise, path=vocabulary, end_id=end_id), "doc_id long, ids binary")


def _histogram(batches, width: int, size: int):
    total = np.zeros(size, dtype=np.int64)
    for batch in batches:
        for part in batch_slices(batch, "ids"):
            total += np.bincount(numbers_of(part.column("ids"), width), minlength=size)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def _encode(batches, width: int, rank_of: np.ndarray):
    """Rows of one part, in its order."""
    start = 0
    for batch in batches:
        for rows in batch_slices(batch, "ids"):
            counts = pc.binary_length(rows.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64) // width
            ends = np.cumsum(counts)
            ranks = rank_of[numbers_of(rows.column("ids"), width)]
            packed = [pack_ranks(ranks[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("part"), rows.column("doc_id"), pa.array(start + ends - counts), pa.array(counts)] + [pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1)],
                names=["part", "doc_id", "start", "n_tokens", "control", "data"],
            )
            start += int(ends[-1])


def _digest(batches, id_of: np.ndarray):
    for batch in batches:
        for rows in batch_slices(batch, "data"):
            control, data, counts = (rows.column(c).to_pylist() for c in ("control", "data", "n_tokens"))
            crc = [zlib.crc32(id_of[unpack_ranks(c, d, n)].tobytes()) for c, d, n in zip(control, data, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("part", "doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


@dataclass
class TokenFiles:
    """A written file set: a folder of parts and one of the rank table."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        return self.spark.read.schema(FILE_SCHEMA).parquet(f"{self.path}/parts")

    def id_of(self) -> np.ndarray:
        """Ids by rank; as long as the vocabulary at most."""
        ranked = self.spark.read.parquet(f"{self.path}/ranks").orderBy("rank").collect()
        return np.array([r["id"] for r in ranked], dtype="<u4")

    def index(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, all from the decoded files.

        Starts add the count inside a part to the totals of the parts before it; the table of totals has
        one row for each part.
        """
        found = self.read().mapInArrow(partial(_digest, id_of=self.id_of()), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
        totals = self.read().groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        return found.join(base, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 0) -> TokenFiles:
    """Tokenise once into a spool, rank ids by their count over all documents, write ordered parts.

    The rank table is collected: it has a row for each id of the vocabulary at most.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    spool = written(token_ids(docs, vocabulary, end_id).withColumn("tie", F.xxhash64("ids")), "spool")
    counts = spool.select("ids").mapInArrow(partial(_histogram, width=width, size=size), "id long, n long")
    ranked = sorted(((r["n"], -r["id"]) for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect()), reverse=True)
    rank_of = np.zeros(size, dtype="<u4")
    for rank, (_, negative) in enumerate(ranked):
        rank_of[-negative] = rank
    path = scratch_path(spark, "token-files")
    spark.createDataFrame([(k, -x) for k, (_, x) in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]  # a hot id is split by its texts
    ordered = spool.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    numbered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    numbered.mapInArrow(partial(_encode, width=width, rank_of=rank_of), FILE_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/parts")
    return TokenFiles(spark, path)
