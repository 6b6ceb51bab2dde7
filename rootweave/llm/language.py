"""Language identification by nearest centroid.

A text is a vector of hashed character 1-, 2- and 3-grams (of the lower-cased text, everything but
letters turned to single blanks), weighted by sub-linear term frequency times inverse document
frequency and scaled to unit length. Every language has several centroids, found by spherical k-means
over its training vectors; a cluster of less than SHARE of them is dropped, so that odd texts get no
centroid of their own. The prediction is the language of the centroid of greatest cosine; a text is
rejected where that cosine is below the limit of that language for texts of so many different grams.

Limits come from a fold of the labelled texts (by a hash of the text, so that copies stay together)
that no centroid was learned from, and from starts of those texts: for each language and each power
of two of different grams, LENIENCE of the median cosine, or SPREAD times median less lower quartile
below it, where that is less. Short or monotonous texts are so judged by others of as little content,
and neither one odd text nor a wrongly labelled minority moves a limit far.

The fit is on a bounded sample: for each label about `per_language` rows, those of least hash of id
and text, so that a hot label or source brings no more rows than any other. The sample is written once in the
shared folder; grams are counted and held-out cosines computed where its rows are. What reaches the driver is
counts of `2^bits` buckets at most for each text learned from, twice `per_language` for each label at most, and
one cosine for each start of a held-out text, whatever the length of texts. Null text, or text without a letter, is `und` with score 0 and rejected.
Where no labelled text has a letter, `fit` raises; `fit_any` gives a model that predicts `und` with score
0 and rejects only texts without letters, as there is nothing to judge others by.
Rows with null labels are never learned. Ties between centroids go to the first label in order.
Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.llm.common import batches_of_rows, ship, written

UNKNOWN = "und"
SHARE = 0.05
LENIENCE = 0.4
SPREAD = 4  # in a normal distribution, four times median less lower quartile cut off a third of a percent
FEWEST = 20  # cosines that a limit needs; with fewer, those of all languages, then the limit of fewer grams
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str, bits: int) -> np.ndarray:
    """Bucket numbers of all 1-, 2- and 3-grams of a text."""
    clean = _NOT_LETTERS.sub(" ", text.lower())
    codes = np.frombuffer(f" {clean} ".encode("utf-32-le"), dtype="<u4").astype(np.uint32)
    mixed = codes * np.uint32(0x9E3779B1)
    two = (mixed[:-1] ^ (mixed[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (mixed[2:] >> np.uint32(11))) * np.uint32(0xC2B2AE35)
    return np.concatenate([mixed, two, three]) >> np.uint32(32 - bits)


def counts(text: str, bits: int) -> np.ndarray:
    """Term frequencies over all buckets, by chunks so that very long texts need no more memory."""
    total = np.zeros(1 << bits, dtype=np.float32)
    for at in range(0, len(text), 1 << 20):
        total += np.bincount(grams(text[max(0, at - 2) : at + (1 << 20)], bits), minlength=1 << bits)
    return total


def sparse(text: str, bits: int) -> bytes:
    """Term frequencies as bytes: buckets, then counts."""
    total = counts(text, bits)
    at = np.flatnonzero(total)
    return at.astype("<u2").tobytes() + total[at].astype("<f4").tobytes()


def dense(rows: list[bytes], bits: int) -> np.ndarray:
    out = np.zeros((len(rows), 1 << bits), dtype=np.float32)
    for i, row in enumerate(rows):
        out[i, buckets(row)] = np.frombuffer(row[len(row) // 3 :], dtype="<f4")
    return out


def buckets(row: bytes) -> np.ndarray:
    return np.frombuffer(row[: len(row) // 3], dtype="<u2")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class CentroidModel:
    bits: int
    idf: np.ndarray
    centroids: np.ndarray
    labels: list[str]  # one for each centroid
    limits: np.ndarray  # for each centroid, by power of two of different grams

    def vectors(self, group: list[str]) -> np.ndarray:
        return self.weighted(np.stack([counts(t, self.bits) for t in group]))

    def weighted(self, frequencies: np.ndarray) -> np.ndarray:
        """Unit vectors of sub-linear term frequency times inverse document frequency."""
        found = np.log1p(frequencies)
        found *= self.idf
        norm = np.linalg.norm(found, axis=1, keepdims=True)
        found /= np.where(norm == 0, 1, norm)
        return found

    def sizes(self, vectors: np.ndarray) -> np.ndarray:
        """Power of two of the different grams of each text."""
        return np.log2(np.maximum(1, (vectors > 0).sum(axis=1))).astype(int)

    def predict(self, group: list[str]) -> tuple[list[str], list[float], list[bool]]:
        if not self.labels:
            return [UNKNOWN] * len(group), [0.0] * len(group), [not has_letter(t) for t in group]
        vectors = self.vectors(group)
        cosine = vectors @ self.centroids.T
        best = cosine.argmax(axis=1)
        labels, scores, rejected = [], [], []
        for text, at, row, limit in zip(group, best, cosine, self.limits[best, self.sizes(vectors)], strict=True):
            known = has_letter(text)
            labels.append(self.labels[at] if known else UNKNOWN)
            scores.append(float(min(1.0, max(0.0, row[at]))) if known else 0.0)
            rejected.append(not known or row[at] < limit)
        return labels, scores, rejected


def _clustered(vectors: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means from spread-out starting points, without clusters of less than SHARE of the vectors."""
    rng = np.random.default_rng(seed)
    centres = vectors[[int(rng.integers(len(vectors)))]]
    while len(centres) < min(k, len(vectors)):
        far = np.maximum(0, 1 - (vectors @ centres.T).max(axis=1)).astype(np.float64)
        if far.sum() == 0:
            break
        centres = np.vstack([centres, vectors[rng.choice(len(vectors), p=far / far.sum())]])
    while True:
        for _ in range(rounds):
            member = (vectors @ centres.T).argmax(axis=1)
            moved = np.stack([vectors[member == j].sum(axis=0) if (member == j).any() else centres[j] for j in range(len(centres))])
            norm = np.linalg.norm(moved, axis=1, keepdims=True)
            centres = moved / np.where(norm == 0, 1, norm)
        members = np.bincount((vectors @ centres.T).argmax(axis=1), minlength=len(centres))
        if members.min() >= SHARE * len(vectors):
            return centres.astype(np.float32)
        centres = np.delete(centres, members.argmin(), axis=0)


def _starts(text: str) -> list[str]:
    """The text and its starts of 4, 8, 16 and so on characters that have letters."""
    starts = [text[: 1 << i] for i in range(2, 13) if 1 << i < len(text)]
    return [t for t in [*starts, text] if has_letter(t)]


def _is_held(text: str) -> bool:
    return crc32(text.encode()) % 4 == 3


def _learned(batches, bits: int, held_too: bool):
    """lang, h and the frequencies of the texts to learn from."""
    for batch in batches:
        for langs, hashes, group in batches_of_rows(batch, ["lang", "h", "text"], 256):
            rows = [(lang, h, sparse(text, bits)) for lang, h, text in zip(langs, hashes, group, strict=True) if has_letter(text) and (held_too or not _is_held(text))]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.binary()], strict=True)], names=["lang", "h", "frequencies"])


def _held_cosines(batches, model: CentroidModel):
    """lang, size and greatest cosine with the language's own centroids, of each start of the held-out texts."""
    for batch in batches:
        for langs, group in batches_of_rows(batch, ["lang", "text"], 256):
            rows = []
            for lang, text in zip(langs, group, strict=True):
                starts = _starts(text) if _is_held(text) and lang in model.labels else []
                if starts:
                    vectors = model.vectors(starts)
                    cosine = (vectors @ model.centroids[[x == lang for x in model.labels]].T).max(axis=1)
                    rows += [(lang, int(n), float(c)) for n, c in zip(model.sizes(vectors), cosine, strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.float64()], strict=True)], names=["lang", "size", "cosine"])


def _limits(model: CentroidModel, cosines: list[tuple[str, int, float]]) -> np.ndarray:
    """Limits for each label's centroids from cosines of texts, and starts of texts, that none was learned from."""
    pooled: list[list[float]] = [[] for _ in range(model.bits + 1)]
    of_label: dict[str, list[list[float]]] = {label: [[] for _ in pooled] for label in model.labels}
    for label, size, cosine in cosines:
        of_label[label][size].append(cosine)
        pooled[size].append(cosine)
    found = np.zeros((len(model.labels), len(pooled)))
    for j, label in enumerate(model.labels):
        for size, own in enumerate(of_label[label]):
            enough = next((x for x in (own, pooled[size]) if len(x) >= FEWEST), None)
            if enough is None:
                found[j, size] = found[j, size - 1] if size else 0.0
                continue
            low, middle = np.quantile(enough, [0.25, 0.5])
            found[j, size] = max(0.0, min(LENIENCE * middle, middle - SPREAD * (middle - low)))
    return found


def fit(docs: DataFrame, training: Column, per_language: int = 1500, centroids: int = 4, bits: int = 13, rounds: int = 8, seed: int = 7) -> CentroidModel:
    """Learn from rows where `training` holds, using their text and non-null lang only.

    A quarter of the sample sets the limits and the rest the centroids; a label of which that leaves
    nothing to learn from learns from all its texts.
    """
    model = fit_any(docs, training, per_language, centroids, bits, rounds, seed)
    if not model.labels:
        raise ValueError("no labelled text to learn from")
    return model


def fit_any(docs: DataFrame, training: Column, per_language: int = 1500, centroids: int = 4, bits: int = 13, rounds: int = 8, seed: int = 7) -> CentroidModel:
    """As `fit`, with a model without centroids where there is nothing to learn from."""
    ship(docs.sparkSession)
    labelled = docs.filter(training & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language; reads no text
    rows = labelled.filter(F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    labels = sorted(sizes)
    model = CentroidModel(bits, np.ones(1 << bits, dtype=np.float32), np.zeros((0, 1 << bits), dtype=np.float32), [], np.zeros((0, bits + 1)))
    if not labels:
        return model
    # a hash below the label's threshold: about `per_language` rows at most, found where they are; repeated rows share a hash and count once
    thresholds = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, per_language / sizes[k]))])
    chance = (F.col("h").cast("double") / 2.0**64) + 0.5
    sample = written(rows.filter(chance <= thresholds[F.col("lang")]).dropDuplicates(["lang", "h"]), "language-sample")

    def learned(chosen: DataFrame, held_too: bool) -> list:
        return chosen.mapInArrow(partial(_learned, bits=bits, held_too=held_too), "lang string, h long, frequencies binary").collect()  # the sample's size bounds it

    learning: dict[str, list[bytes]] = {}
    texts = learned(sample, False)
    without = sorted(set(labels).difference(r["lang"] for r in texts))
    if without:
        texts += learned(sample.filter(F.col("lang").isin(without)), True)
    for r in sorted(texts, key=lambda r: (r["lang"], r["h"], r["frequencies"])):
        learning.setdefault(r["lang"], []).append(r["frequencies"])
    del texts
    if not learning:
        return model
    seen = np.zeros(1 << bits)
    for own in learning.values():
        for row in own:
            seen[buckets(row)] += 1
    model.idf = np.log((1 + sum(map(len, learning.values()))) / (1 + seen)).astype(np.float32) + 1
    kept = []
    for label, own in learning.items():
        centres = _clustered(model.weighted(dense(own, bits)), centroids, rounds, seed)
        kept.append(centres)
        model.labels += [label] * len(centres)
    model.centroids = np.vstack(kept)
    cosines = sample.mapInArrow(partial(_held_cosines, model=model), "lang string, size int, cosine double").collect()  # a few for each held-out text
    model.limits = _limits(model, sorted(map(tuple, cosines)))
    return model


def _predict(batches, model: CentroidModel):
    for batch in batches:
        for ids, group in batches_of_rows(batch, ["row_id", "text"], 256):
            labels, scores, rejected = model.predict([t or "" for t in group])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("row_id").type), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["row_id", "lang_pred", "score", "rejected"],
            )


def predict(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected; a narrow map. The model is a few hundred kilobytes."""
    ship(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("row_id"), "text").mapInArrow(partial(_predict, model=model), "row_id long, lang_pred string, score double, rejected boolean")
    return found.withColumnRenamed("row_id", "doc_id")


def _keep(batches, model: CentroidModel):
    for batch in batches:
        keep: list[bool] = []
        for (group,) in batches_of_rows(batch, ["text"], 256):
            keep += [not x for x in model.predict([t or "" for t in group])[2]]
        yield batch.filter(pa.array(keep, pa.bool_()))


def accepted(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """The rows, with all their columns, whose text is not rejected."""
    ship(docs.sparkSession)
    return docs.mapInArrow(partial(_keep, model=model), docs.schema)


def held_out(doc_id: Column, remainder: int = 2) -> Column:
    """crc32 of the id as text, modulo 4, is `remainder`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == remainder
