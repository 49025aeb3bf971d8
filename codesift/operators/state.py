"""Human decisions and status changes on the findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = {"approve": "approved", "reject": "rejected"}  # fixed values


def update_findings(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """Update by id. Only columns of `updates` change; unknown ids are ignored; job and repository stay."""
    changed = [c for c in updates.columns if c not in ("id", "job_id", "repo")]
    new = updates.select("id", F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in changed])
    return findings.join(new, "id", "left").select(
        *[F.when(F.col("hit"), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
          for c in findings.columns])


def fold_decisions(decisions: DataFrame) -> DataFrame:
    """One row per finding: last status and notes, last rewrite that is not blank.

    A plain aggregate: partial results are combined before the shuffle, so a finding with very many decisions is
    no hot spot. Unknown actions count for nothing.
    """
    valid = decisions.where(F.col("action").isin(list(ACTIONS)))
    snippet = F.when(F.regexp_replace("proposed_snippet", r"\s+", "") != "", F.col("proposed_snippet"))
    return valid.groupBy(F.col("finding_id").alias("id")).agg(
        F.max_by("action", "seq").alias("action"),
        F.max_by(F.coalesce("notes", F.lit("")), "seq").alias("reviewer_notes"),
        F.max_by(snippet, F.when(snippet.isNotNull(), F.col("seq"))).alias("proposed_snippet"),
    ).select(
        "id", F.when(F.col("action") == "approve", ACTIONS["approve"]).otherwise(ACTIONS["reject"]).alias("status"),
        "reviewer_notes", "proposed_snippet")


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings after all decisions; any status can move to approved or rejected."""
    return update_findings(findings, fold_decisions(decisions))


def decision_rejects(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that change nothing, with the reason; an unknown finding is reported first."""
    known = findings.select(F.col("id").alias("finding_id")).distinct().withColumn("known", F.lit(True))
    reason = F.when(F.col("known").isNull(), "unknown finding").when(
        ~F.coalesce(F.col("action").isin(list(ACTIONS)), F.lit(False)), "unknown action")
    return (
        decisions.join(known, "finding_id", "left").withColumn("reason", reason)
        .where("reason IS NOT NULL").select("finding_id", "seq", "action", "reason")
    )


def approved_findings(findings: DataFrame, repo: str, job_id: str | None = None) -> DataFrame:
    chosen = findings.where((F.col("status") == "approved") & (F.col("repo") == repo))
    return chosen.where(F.col("job_id") == job_id) if job_id else chosen


def report_eligibility(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requested job ids with NULL (may be patched) or the reason why not."""
    known = jobs.select(F.col("id").alias("job_id"), "source")
    reason = F.when(F.col("source").isNull(), "job not found").when(F.col("source") != "github", "local scan")
    return requests.join(known, "job_id", "left").select("job_id", reason.alias("reason"))


def mark_applied(findings: DataFrame, used: DataFrame) -> DataFrame:
    return update_findings(findings, used.select("id").distinct().withColumn("status", F.lit("applied")))
