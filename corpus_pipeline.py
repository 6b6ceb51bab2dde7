"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes all that the stage before it kept. A stage is written as Parquet in the shared folder and
read again; all but the last return the columns of documents, and of any further columns that they came with.

Odd rows. A null or empty text has no letter, so language_id lets it go, and no later stage meets one but as
what line_dedup has left of a document; such an empty rest stays, is near to nothing, holds no benchmark item and is
packed as the end id alone. Rows of one doc_id count as one document in near_dedup: all stay or all go. Rows with a null
doc_id are never near duplicates and go through the other stages like any row. Repeated rows are rows.
An empty table, or one without labels, benchmark items or letters, gives empty or unchanged stages, never an
error. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.llm import language
from rootweave.llm.common import table, written
from rootweave.llm.decontam import decontaminated
from rootweave.llm.line_runs import dedup_lines
from rootweave.llm.near_dups import BROADCAST_IDS, near_duplicates
from rootweave.llm.packing import pack
from rootweave.llm.vocab import default_vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the centroids of the labelled languages accept; all with a letter where none is labelled."""
    return language.accepted(docs, language.fit_any(docs, F.lit(True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share, but in the last of them."""
    found = dedup_lines(docs, carry=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of documents linked by five-word shingles at 0.8."""
    gone = written(near_duplicates(docs, percent=80, width=5).filter(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens in the mixture of sources that is left."""
    return pack(docs, default_vocabulary("word_bpe_49k.json"), end_id=1, size=2048)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenisers and centroids are beyond SQL; tests compare each stage with brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
