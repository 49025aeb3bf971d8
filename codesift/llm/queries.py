"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.llm import (
    decontamination, html_text, language, lexical_search, oracles, packing, quality_qda, quality_rules, rows, secret_scan, simhash,
    token_counts, token_files, warc, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition counts of every document and the verdict of the threshold table."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[secret_scan.n_spans("base", kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.written("base"), 256).alias("base_sha256"), secret_scan.written("spans").alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document it reaches over links of two bits or fewer."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files of directly addressable codes, read back."""
    path = rows.shared_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.packed(packing.pieces(_table(spark, sf_dir, "documents")).drop("ids"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counts = token_counts.counted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counts.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    found = quality_qda.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~held_out))
    return language.predicted(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), language.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extracted(_table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives in which equal payloads are stored once, read back."""
    path = rows.shared_path(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    found = lexical_search.ranked(
        _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row.item_id").alias("item_id"), "rank", "doc_id", "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 whitened components of every usable embedding."""
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    return found.select("*", F.posexplode("whitened").alias("k", "value")).select(
        F.col("row.vec_id").alias("vec_id"), (F.col("k") + 1).alias("component"), "n", "deviation",
        F.col("value").alias("whitened"), F.get("explained", F.col("k")).alias("explained"), "identity_error")


QUERIES = {
    "op11_warc": op11_warc,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
    "op1_html_text": op1_html_text,
    "op6_quality_qda": op6_quality_qda,
    "op9_language": op9_language,
    "op2_token_files": op2_token_files,
    "op4_packing": op4_packing,
    "op10_token_counts": op10_token_counts,
    "op8_simhash": op8_simhash,
    "op5_decontamination": op5_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op7_quality_rules": op7_quality_rules,
}

ORACLES = {
    "op11_warc": oracles.WARC,
    "op12_lexical_search": oracles.LEXICAL_SEARCH,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op3_secret_scan": oracles.SECRET_SCAN,
    "op7_quality_rules": oracles.QUALITY_RULES,
}
