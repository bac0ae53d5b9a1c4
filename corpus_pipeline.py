"""A corpus pipeline over ``documents``: five stages, each one operator.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last returns the pieces of packed training sequences.

A null text counts as an empty one.  Rows that repeat an id are taken as they
come; where one of them decides about a document, the others go or stay with it.
Rows without an id are never compared with others.  Columns besides those of
``documents`` are carried along, whatever their names, and a stage on an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomer.llm import decontaminate, langid, line_dedup, neardup, packing
from fathomer.llm.queries import vocabulary
from fathomer.workspace import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay; those without a letter are told none.

    A missing declared language or source is no evidence.
    """
    return langid.keep_told(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the one of the largest id; texts and lengths follow.

    No row goes; a text may become empty, and a null one does.
    """
    kept = line_dedup.with_kept_text(docs)
    return kept.select(*[_renewed(c) for c in docs.columns])


def _renewed(column: str) -> Column:
    if column == "text":
        return F.col("kept_text").alias("text")
    return F.length("kept_text").cast("long").alias("n_chars") if column == "n_chars" else F.col(column)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id: shingles of five words, similarity 0.8.

    Texts without words, and rows without an id, are like no others and stay.
    """
    return neardup.keep_first(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay, and so do rows without an id."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 1024 tokens; an empty text is the end token alone."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Trained language models and tokenizers have no SQL; ``tests/llm`` has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
