"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of documents; n_chars follows a changed text. The
last returns the pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

Defined results: null and empty texts fail the base rules and go; null ids are kept by all
stages, and never name a class; of rows equal in id and text one stays, as of other
copies; all further columns of documents pass through, whatever their names; an empty table
gives empty results; without labels the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import jaccard, linedup, packing, pii, rules
from isohyet.llm.common import table, written
from isohyet.llm.queries import tokenizer_file


def _with_chars(docs: DataFrame) -> DataFrame:
    """n_chars after the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; documents without a word left go."""
    lost = linedup.lost_column(docs)
    left = linedup.dedup(docs).where(~((F.size(lost) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return _with_chars(left.drop(lost))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least id."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base spans and disclosing terms are masked or removed."""
    return _with_chars(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: No SQL for the trained rules, the sampled candidates and the fitted packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs)
    return docs
