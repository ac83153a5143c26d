"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, written as Parquet, and does its whole
operator: documents that the quality classifier rejects go, lines that are
boilerplate of their source go, one document of each near-duplicate group (five-word
shingles, similarity 0.8) stays, sources are mixed to their target weights, and the
documents are packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import linededup, mixing, neardedup, packing, quality
from lexiloom.llm.common import materialize, table

#: Quality needs a trained model and packing a vocabulary: neither is SQL. tests/llm/test_pipeline.py holds run() against plain walks over the documents.
ORACLE_SQL = None


# Every stage takes rows with doc_id, text and source, whatever columns else; nulls, empty texts, repeated rows and empty
# tables give what the operator's docstring says.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more. Null and empty texts are scored as empty ones; repeated rows go or stay together."""
    return quality.keep_good(spark, docs, sf_dir)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that over a tenth of their source's documents hold. No document goes; null texts and empty ones stay as they are, null sources are one."""
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least doc_id. Texts without words all stay; rows that repeat become one."""
    return neardedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the sampling draws it, up to three times. Texts without words are drawn like others; null sources are one."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece, with its sequence and place. A text without tokens is its end token; each row is packed by itself, however often it repeats."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
