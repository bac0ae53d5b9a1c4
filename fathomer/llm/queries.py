"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomer.llm import decontaminate, html_text, langid, licenses, line_dedup, neardup, oracle, packing, quality, secrets, warc
from fathomer.workspace import new_path, read_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that three documents share stay in one."""
    out = line_dedup.with_kept_text(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences and licence notices of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold, as pairs."""
    return decontaminate.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archive records, read back and told apart by payload."""
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether it reads like trusted ones."""
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.drop("score")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file, which every worker has."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    # Read as it is: a task that runs again must see its rows in the same order.
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from its text, declared language and source."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, from its main text, markup and address."""
    return langid.of_pages(_table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: patterns, and keys and tokens that parse."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "langid_pages": langid_pages,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL = {
    "op1_line_dedup": oracle.LINE_DEDUP,
    "op2_license_scan": licenses.oracle_sql(),
    "op3_decontamination": oracle.DECONTAMINATION,
    "op4_minhash_near_dedup": oracle.NEAR_DEDUP,
    "op5_warc": oracle.WARC,
    "op6_quality_rules": oracle.quality_rules(quality.BUCKETS, quality.SHRINK, quality.THRESHOLD, quality.MAX_TRUSTED),
    "op10_secret_scan": oracle.secret_scan(),
}
