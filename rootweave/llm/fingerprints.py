"""Document fingerprints by winnowing; DataFrame functions only.

A text is cut to units: of letters and digits up to four, ending at the first a, o, 0 or 5 among them, so that
cuts find back to each other after an edit inside a long unspaced run; of scripts without spaces one character;
of others one that is not white space. Every `k` adjacent units form a gram with a 32-bit hash. Of every `window` adjacent
grams the one of least hash is chosen, the rightmost of equals; a gram chosen by several windows
is kept once, with its position. Two texts that share `window + k - 1` units share a
fingerprint entry (the match guarantee).

Gram hashes roll up from unit hashes: arrays of hashes of 1, 2, 4 ... adjacent units are joined
element by element with themselves moved on. Hash and position are then held in one long, `hash *
2^31 + (2^31 - 1 - position)`: the least of these longs is the least hash and, of equals, the
rightmost. Window minima roll up in the same way, so the work for each unit grows with the
logarithms of `k` and of the window.

Null and empty texts have an empty fingerprint; a text of fewer than `k` units has the hash of them
all. Equal texts have equal fingerprints. Texts are taken whole, whatever their length; repeated rows each
have their own result, and an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootweave.llm.common import shuffle_partitions, texts, written

#: Scripts without spaces: Thai and Lao, Myanmar, Khmer, kana, Han, Hangul.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\U00020000-\U0003ffff"
_WORD = r"\p{L}\p{M}\p{N}"
#: Units of a text.
UNIT = rf"[{_UNSPACED}]|[{_WORD}]{{0,3}}?[ao05]|[{_WORD}]{{1,4}}|[^\s{_WORD}]"
_TOP = (1 << 31) - 1


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _moved(array: Column, places: int) -> Column:
    return F.slice(array, F.lit(places + 1), F.greatest(F.size(array), F.lit(1)))


def _rolled(array: Column, length: int, join, use) -> Column:
    """use(array of join() over every `length` adjacent elements); those past the end are cut short."""
    if length == 1:
        return use(array)
    half = 1 << (length - 1).bit_length() - 1

    def from_half(done: Column) -> Column:
        if length - half == half:
            return _let(F.zip_with(done, _moved(done, half), join), use)
        return _rolled(array, length - half, join, lambda rest: _let(F.zip_with(done, _moved(rest, half), join), use))

    return _rolled(array, half, join, from_half)


def winnow(text: Column, k: int = 5, window: int = 5) -> Column:
    """Array of longs in order of position; see `hashes` and `positions`."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))

    def choose(grams: Column) -> Column:
        whole = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - (k - 1), F.least(F.size(grams), F.lit(1))))
        keys = F.transform(whole, lambda h, at: F.shiftleft(F.shiftrightunsigned(h, 32), 31) + (F.lit(_TOP) - at).cast("long"))
        return _let(keys, lambda keys: _rolled(keys, window, lambda a, b: F.least(a, b), least))

    def least(minima: Column) -> Column:
        full = F.greatest(F.size(minima) - (window - 1), F.least(F.size(minima), F.lit(1)))
        return F.array_distinct(F.slice(minima, F.lit(1), full))

    hashed = F.transform(units, lambda unit: F.xxhash64(unit))
    return _let(hashed, lambda h: _rolled(h, k, lambda a, b: F.xxhash64(a, b), choose))


def hashes(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: F.shiftright(x, 31))


def positions(fingerprint: Column) -> Column:
    """Index of the first unit of each chosen gram."""
    return F.transform(fingerprint, lambda x: F.lit(_TOP) - x.bitwiseAND(F.lit(_TOP)))


def printed(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each chosen hash, in order of position."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(F.shiftright(x, 31))), 8, "0")), "")


def printed_positions(fingerprint: Column) -> Column:
    """Positions in decimal, parted by commas."""
    return F.array_join(positions(fingerprint), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hash sets; two empty fingerprints are alike."""
    shared = F.size(F.array_intersect(a, b))
    joined = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), joined.cast("double")), F.lit(1.0))


def fingerprints(docs: DataFrame, k: int = 5, window: int = 5) -> DataFrame:
    """doc_id, hashes, positions for every document."""
    found = texts(docs).select("doc_id", winnow(F.col("text"), k, window).alias("f"))
    return found.select("doc_id", hashes(F.col("f")).alias("hashes"), positions(F.col("f")).alias("positions"))


def with_next(docs: DataFrame, k: int = 5, window: int = 5, bits: int = 8) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint; next in descending doc_id order, then the first.

    Ids are dealt to ranges of 2^bits and every text moves once, to its range. The last document of
    a range needs the first one of the next lower range that is not empty: these heads, one for each
    range, are picked from the same exchange and joined by range. Ranges themselves are dealt in order
    to as many parts as the session shuffles to, so their neighbours are found inside a part, and those across
    parts from one row for each part. Null ids come last, ordered by hash and text; rows with equal ids
    are ordered by their text.
    """
    spark = docs.sparkSession
    unknown = F.lit(-(1 << 62)) + F.xxhash64("text").bitwiseAND(F.lit((1 << 32) - 1))
    dealt = texts(docs).withColumn("range", F.coalesce(F.shiftright("doc_id", bits), unknown))
    in_range = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "text")

    with_ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").select(F.shiftright("doc_id", bits).alias("range"))  # reads ids alone
    known = with_ids.unionByName(dealt.filter("doc_id IS NULL").select("range")).distinct().repartitionByRange(shuffle_partitions(spark), F.desc("range"))
    known = written(known.select("range", F.spark_partition_id().alias("part")), "ranges")
    ends = known.groupBy("part").agg(F.min("range").alias("bottom"))
    over_parts = Window.orderBy("part")  # a row for each shuffle partition
    ends = ends.select("part", F.coalesce(F.lag("bottom").over(over_parts), F.min("bottom").over(Window.partitionBy())).alias("above_part"))
    higher = F.lag("range").over(Window.partitionBy("part").orderBy(F.desc("range")))
    to = known.select("range", "part", higher.alias("above")).join(ends, "part").select("range", F.coalesce("above", "above_part").alias("to"))
    dealt = dealt.repartition("range")

    heads = dealt.withColumn("n", F.row_number().over(in_range)).filter("n = 1").join(to, "range")
    heads = heads.select(F.col("to").alias("range"), F.col("text").alias("head_text"), winnow(F.col("text"), k, window).alias("head_f"))

    found = dealt.withColumn("f", winnow(F.col("text"), k, window))
    found = found.select(
        "doc_id", "text", "range", "f", F.lead("text").over(in_range).alias("later_text"), F.lead("f").over(in_range).alias("later_f")
    ).join(heads, "range")
    return found.select(
        "doc_id", "text", F.col("f").alias("fingerprint"), F.coalesce("later_text", "head_text").alias("next_text"),
        F.when(F.col("later_text").isNull(), F.col("head_f")).otherwise(F.col("later_f")).alias("next_fingerprint"),
    )
