"""Documents to packed training sequences in five stages, each on all that the one before it kept.

run() writes every stage's result as Parquet below the shared checkpoint folder and reads it again for the next. All but
the last stage return the columns of documents, whatever they are. Null and empty texts are rejected by the first stage;
an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesift.llm import decontamination, packing, quality_rules, rows, secret_scan, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group linked by fingerprints of 3-word shingles that differ
    in two bits or fewer."""
    return simhash.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 1024 tokens."""
    return packing.packed(packing.pieces(docs).drop("ids"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: Near copies and minimum bin slack are beyond SQL: run() is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = rows.landed(stage(spark, docs, sf_dir))
    return docs
