"""Benchmark decontamination: rare word-pair seeds join documents to test items, alignment scores the copies.

Words are white-space tokens, lower-cased, with punctuation stripped at both ends. The score of a document and an item
is the share of the best local alignment (Smith-Waterman over words: match 2, mismatch and gap -1) in a perfect one, 2L for
an item of L words. Pairs that score `threshold` or more are reported; of items with three words or more, all of them.

Seeds. An alignment at threshold t has m matches and at most 2m - 2tL other steps, so at least tL - 1 of its m - 1
intervals between matches have at most one step: there two words that are one or two places apart in the item are one or
two places apart in the document. A seed is such a pair of words with the gap left open, and each of an item's words but the last
begins up to two. So edits between any two words (one put in, left out or replaced) leave seeds, and an item of which only the
`tL - 1` least of its L - 1 seed places survive is still met: a few more than the other (1 - t)L places, those
with the rarest seeds, are looked up, and a document must hold up to three of them. How rare a seed is, is counted over all documents.

Flow. (1) One pass over the documents writes, for each, the keys of its pairs that some item has; a bitmap of item keys, whose size is
bounded (2^27 bits), keeps others out. (2) Document frequencies, and from them each item's rarest places. (3) Hits join seeds, and
documents with enough of them become candidates of the item. (4) Candidates' texts, each with up to `ITEMS` items, are
aligned: only stretches that hold at least tL - 1 pairs of the item within an alignment's reach, to its end. The test
set is never on the driver and costs no further pass, however large it is.

A document is known by a hash of its id and text; rows of equal hashes are candidates of the same items, and each is aligned by
itself. Items of two words are met by their pair, those of one word by the word. Null or empty texts and items match nothing. Repeated
items and documents are each reported, rows with null ids with null ids. Empty tables give no rows. Texts are read whole; extra columns are
ignored, or kept by `decontaminated`.
"""

from __future__ import annotations

import math
import string
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.common import batches_of_rows, ship, written
from rootweave.llm.vocab import slices_of

MATCH, MISMATCH, GAP = 2, -1, -1
MATCHES = "doc_id long, item_id long, score double, first_word long, last_word long"
#: Candidates, or seeds, of this many rows may be sent to all tasks.
BROADCAST_ROWS = 1_000_000
#: Items that are aligned beside one copy of a text.
ITEMS = 64
BITS = 27
_MARKS = string.punctuation + "“”‘’«»¿¡…–—"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _split(group: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, list[str]]:
    """White-space tokens of all texts as codes, where each text starts, and the word of each code ("" for none)."""
    split = pc.utf8_split_whitespace(pa.array(group, pa.large_string()))
    coded = split.flatten().dictionary_encode()
    return coded.indices.to_numpy(), split.offsets.to_numpy(), [w.lower().strip(_MARKS) for w in coded.dictionary.to_pylist()]


def words_of(text: str) -> list[str]:
    codes, _, words = _split([text])
    return [words[c] for c in codes.tolist() if words[c]]


def hashed_words(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text starts."""
    from xxhash import xxh3_64_intdigest

    codes, starts, words = _split(group)
    number = np.array([xxh3_64_intdigest(w) if w else 0 for w in words] or [0], dtype=np.uint64)
    filled = np.array([bool(w) for w in words] or [False])[codes]
    return number[codes[filled]], np.concatenate([[0], np.cumsum(filled)])[starts]


def pair_keys(words: np.ndarray, apart: int) -> np.ndarray:
    """Keys of the words `apart` places from each other; of single words for 0."""
    if not apart:
        return words ^ _STEP
    first, second = words[:-apart], words[apart:]
    key = (first ^ (first >> np.uint64(31))) * _STEP + second
    return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def least_light(length: int, threshold: float) -> int:
    """Seed places of an item that an alignment at the threshold keeps at least."""
    return max(1, math.ceil(threshold * length - 1e-9) - 1)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the passage position where it ends."""
    slope = np.arange(len(passage), dtype=np.int64) * -GAP
    above = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item.tolist():
        row = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope  # gaps in the item
        above[1:] = row
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _item_places(batches):
    """A row for each seed place and key of an item; `length` is its number of words."""
    for batch in batches:
        rows, group = batch.column("row").to_pylist(), batch.column("text").to_pylist()
        words, starts = hashed_words(group)
        out: list[tuple] = []
        for row, low, high in zip(rows, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own = words[low:high]
            for apart in (0,) if len(own) == 1 else (1, 2):
                out += [(row, len(own), place, key) for place, key in enumerate(pair_keys(own, apart).view(np.int64).tolist())] if len(own) > apart else []
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "length", "place", "key"])


def _hits(batches, bitmap: np.ndarray, singles: bool):
    """Distinct keys of a document's pairs (and words) that the bitmap holds."""
    mask = np.uint64(len(bitmap) * 64 - 1)
    for batch in batches:
        for docs, group in batches_of_rows(batch, ["doc", "text"], 1024):
            for a, b in slices_of(group):
                words, starts = hashed_words(group[a:b])
                owner = np.repeat(np.arange(b - a), np.diff(starts))
                found, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for apart in (0, 1, 2) if singles else (1, 2):
                    if len(words) <= apart:
                        continue
                    key = pair_keys(words, apart)
                    low = key & mask
                    inside = (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0
                    at = np.flatnonzero(inside & (owner[: len(key)] == owner[len(words) - len(key) :]))
                    found.append(owner[at])
                    keys.append(key[at])
                owners, key = np.concatenate(found), np.concatenate(keys)
                order = np.lexsort((key, owners))
                owners, key = owners[order], key[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (owners[1:] != owners[:-1])
                names = np.array(docs[a:b], dtype=np.int64)[owners[new]]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(key[new].view(np.int64), pa.int64())], names=["doc", "key"])


def _stretches(words: np.ndarray, item: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Parts of a text that could hold an alignment at the threshold."""
    length = len(item)
    # m matches, x mismatches and g gaps score 2m - x - g, so at the threshold they span at most 3m - 2tL words
    reach = math.ceil((MATCH + 1 - MATCH * threshold) * length)
    if length == 1:
        light = words == item[0]
    else:
        known = np.unique(np.concatenate([pair_keys(item, apart) for apart in (1, 2) if length > apart]))
        light = np.zeros(len(words), dtype=bool)
        for apart in (1, 2):
            if len(words) > apart:
                light[: len(words) - apart] |= np.isin(pair_keys(words, apart), known)
    total = np.concatenate([[0], np.cumsum(light)])
    ends = np.minimum(np.arange(len(words)) + reach, len(words))
    starts = np.flatnonzero(light & (total[ends] - total[:-1] >= least_light(length, threshold)))
    out: list[tuple[int, int]] = []
    for start in starts.tolist():
        end = min(start + reach, len(words))
        low = max(0, start - reach)  # an alignment may begin before its first light interval
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((low, end))
    return out


def _best(words: np.ndarray, item: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    best = None
    for low, high in _stretches(words, item, threshold):
        score, end = smith_waterman(item, words[low:high])
        share = score / (MATCH * len(item))
        if share >= threshold and (best is None or share > best[0]):
            best = (share, max(0, low + end - len(item) + 1), low + end)
    return best


def _aligned(batches, threshold: float):
    for batch in batches:
        for doc_ids, digests, group, items in batches_of_rows(batch, ["doc_id", "digest", "text", "items"], 16):
            words, starts = hashed_words(group)
            out: list[tuple] = []
            for doc_id, digest, low, high, held in zip(doc_ids, digests, starts[:-1].tolist(), starts[1:].tolist(), items, strict=True):
                own, ends = hashed_words([i["text"] for i in held])
                for item, a, b in zip(held, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    found = _best(words[low:high], own[a:b], threshold)
                    if found:
                        out.append((doc_id, item["item_id"], *found, digest))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word", "digest"])


def _bitmap(places: DataFrame) -> np.ndarray:
    """Words of 64 bits of a bitmap of the items' keys, about 16 bits a key and 2^BITS at most."""
    n = places.select("key").distinct().count()
    width = 1 << min(BITS, max(10, (16 * n).bit_length()))
    low = F.col("key").bitwiseAND(F.lit(width - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    rows = places.select(F.shiftright(low, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # width / 64 rows at most
    out = np.zeros(width // 64, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _rare_seeds(places: DataFrame, hits: DataFrame, threshold: float, spare: int = 3) -> DataFrame:
    """key, row, place, need: the rarest seed places of each item, and how many of them a document must hold."""
    frequency = hits.groupBy("key").agg(F.count(F.lit(1)).alias("documents"))
    known = places.join(frequency, "key", "left")
    cost = known.groupBy("row", "length", "place").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("cost"))
    light = F.greatest(F.lit(1), F.ceil(F.col("length") * threshold - 1e-9) - 1)
    spots = F.greatest(F.col("length") - 1, F.lit(1))
    wanted = F.least(spots, spots - light + spare)
    order = Window.partitionBy("row").orderBy("cost", "place")  # an item's words
    chosen = cost.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= wanted)
    need = F.greatest(F.lit(1), wanted - spots + light)
    return chosen.select("row", "place", need.alias("need")).join(places.select("row", "place", "key"), ["row", "place"])


def _dealt(rows: DataFrame) -> DataFrame:
    """A small table for all tasks, a large one for a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _matched(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """MATCHES, and digest: a hash of the document's text."""
    ship(docs.sparkSession)
    name = F.xxhash64("doc_id", "text").alias("doc")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull()).select(name, "doc_id", "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "bench-items")  # numbers stand once written
    places = written(items.select("row", "text").mapInArrow(_item_places, "row long, length long, place long, key long"), "bench-places")
    singles = not places.filter("length = 1").isEmpty()
    hits = plain.select("doc", "text").mapInArrow(partial(_hits, bitmap=_bitmap(places), singles=singles), "doc long, key long")
    hits = written(hits, "bench-hits")
    seeds = written(_rare_seeds(places, hits, threshold), "bench-seeds")
    met = hits.join(_dealt(seeds), "key").groupBy("doc", "row", "need").agg(F.countDistinct("place").alias("n")).filter("n >= need")
    met = written(met.select("doc", "row"), "bench-met")
    chunk = F.pmod(F.xxhash64("row"), F.col("chunks")).alias("chunk")
    sizes = met.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / ITEMS).cast("long").alias("chunks"))
    held = met.join(sizes, "doc").select("doc", chunk, "row").join(_dealt(items), "row")
    held = held.groupBy("doc", "chunk").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))  # about ITEMS
    wanted = plain.join(_dealt(met.select("doc").distinct()), "doc")
    rows = wanted.join(held.select("doc", "items"), "doc").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text", "items")
    return rows.mapInArrow(partial(_aligned, threshold=threshold), f"{MATCHES}, digest string")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each pair of a document and a test item that it holds, wholly or edited."""
    return _matched(docs, benchmark, threshold).drop("digest")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that hold no test item."""
    gone = written(_matched(docs, benchmark, threshold).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "bench-gone")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.md5(docs["text"].cast("binary")) == F.col("_digest"))
    return docs.join(_dealt(gone), same, "left_anti")
