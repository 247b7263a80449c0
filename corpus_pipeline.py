"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and the documents that its predecessor kept, and returns
the documents' columns; the last returns the pieces of the packed sequences. Between stages the
rows are written as Parquet and read again, which cuts the lineage.

Defined cases: null and empty texts pass every stage and pack as their end sign alone; texts may
have any length; rows without an id are scored, linked, cut (as coming before all others),
redacted and packed like the rest; rows that repeat an id with a text stay once, unless the text
has no word; columns beyond the documents' own, whatever their names, are left out by the first
stage; without labels of either kind nothing is toxic; empty tables give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_dedup, packing, pii, suffix_dedup, toxicity
from tidemark.llm.common import read, stored

#: The documents' columns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No stage but the packing could be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _told(docs: DataFrame) -> DataFrame:
    """The documents' columns, n_chars counted anew (null text: 0)."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. The labels train; no label decides."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies (five words, 0.8)."""
    return near_dedup.deduplicated(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document has."""
    return _told(suffix_dedup.without_repeats(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the kind in brackets."""
    return _told(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, as one record per piece of a document."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("suffix-array-dedup", cut_repeats),
    ("pii", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
