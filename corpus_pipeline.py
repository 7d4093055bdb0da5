"""Corpus pipeline: toxicity, near-duplicates, benchmark contamination, personal data and piece encoding, in this order.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, jaccard, pieces, pii, queries, toxicity
from cohortlens.llm.common import cut


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text; nulls stay."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go; it is fitted on the labelled documents."""
    return toxicity.reject(docs, queries.toxicity_machine(spark, sf_dir))


def one_of_each_class_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their 5-word shingles, the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def benchmark_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items are cut out; documents that consist of them by more than half go."""
    return _sized(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")))


def personal_data_is_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid identifiers become pseudonyms of their format."""
    return _sized(pii.replace(docs, key=queries.pseudonym_key(spark)))


def documents_are_encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    return pieces.encode_pieces(docs, pieces.read_vocabulary(f"{queries.TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_duplicates", one_of_each_class_stays),
    ("decontamination", benchmark_passages_go),
    ("pii", personal_data_is_replaced),
    ("pieces", documents_are_encoded),
]

#: SQL can't express a fitted model, keyed permutations and piece encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the second stage's input, which it passes over several times, is checkpointed."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, cut(docs) if name == "near_duplicates" else docs, sf_dir)
    return docs
