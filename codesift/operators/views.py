"""Read views: lists, counts, the review queue, job summaries and the scan report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift import schemas as S


def list_findings(findings: DataFrame, job_id: str | None = None, status: str | None = None,
                  repo: str | None = None) -> DataFrame:
    """Findings in id order; each given filter must hold. An unknown status is an error."""
    if status and status not in S.STATUSES:
        raise ValueError(f"unknown status: {status}")
    for column, value in (("job_id", job_id), ("status", status), ("repo", repo)):
        if value:
            findings = findings.where(F.col(column) == value)
    return findings.orderBy("id")


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("id"))


def status_counts(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One column per status, zero when there is none; over everything or per given columns."""
    return findings.groupBy(*(by or [])).agg(
        *[F.count_if(F.col("status") == s).cast("bigint").alias(s) for s in S.STATUSES])


def shortened(text: Column, limit: int = 180) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def place() -> Column:
    return F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"))


def queue_view(findings: DataFrame, job_id: str | None = None, status: str | None = None) -> DataFrame:
    return list_findings(findings, job_id, status).select(
        "id", "severity", "status", place().alias("place"), "repo", "language", "title",
        shortened(F.col("reasoning")).alias("reasoning"))


def job_view(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """Jobs with their findings count and whether a patch can be asked for (any approved finding, remote source)."""
    approved = findings.agg(F.count_if(F.col("status") == "approved").alias("n")).scalar()
    return jobs.select("id", "repo", "findings_count", ((F.col("source") == "github") & (approved > 0)).alias("can_patch"))


def status_view(findings: DataFrame, job_id: str | None = None) -> DataFrame:
    return list_findings(findings, job_id).select(
        F.left("id", F.lit(8)).alias("id"), "status", "severity", "repo", "title")


def job_summary(source_files: DataFrame, candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Per repository and ref: files_scanned, candidates_found, findings_count; zero counts are shown."""
    keys = ["repo", "ref"]
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").cast("int").alias(name))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return (
        count(source_files, "files_scanned")
        .join(count(candidates, "candidates_found"), keys, "left")
        .join(count(findings, "findings_count"), keys, "left")
        .select(*keys, "files_scanned", zero("candidates_found"), zero("findings_count"))
    )


def job_rows(summary: DataFrame, job_id: Column, source: Column, created_at: Column) -> DataFrame:
    """The rows of the jobs table for a job_summary()."""
    return summary.select(
        job_id.alias("id"), "repo", "ref", source.alias("source"), created_at.alias("created_at"),
        "files_scanned", "candidates_found", "findings_count")


def numbered(rows: DataFrame, keys: list[str], path: str = "path", depth: int = 3) -> DataFrame:
    """Add position (1..n, by the parts of the path) and total per key without a task that holds a key's rows.

    Beginnings of arrays sort as the arrays do: rows are ranked among those that share their first depth parts, and the
    counts of the beginnings before give the rest. A larger depth splits a directory with very many files.
    """
    parts = F.split(path, "/")
    rows = rows.select("*", parts.alias("_parts"), F.slice(parts, 1, depth).alias("_head"))
    before = Window.partitionBy(*keys).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*keys, "_head").count().select(
        *keys, "_head", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
        F.sum("count").over(Window.partitionBy(*keys)).alias("total"))
    within = Window.partitionBy(*keys, "_head").orderBy("_parts")
    return rows.withColumn("_nth", F.row_number().over(within)).join(heads, [*keys, "_head"]).withColumn(
        "position", F.col("_nth") + F.col("_offset")).drop("_head", "_parts", "_nth", "_offset")
