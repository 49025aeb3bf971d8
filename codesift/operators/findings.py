"""Candidates to findings: defaults, review requests, and review answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift import schemas as S
from codesift.functions import text as X


# --- Fixed values: the text of a review request ------------------------------------------------
REQUEST = (
    "Repository: {repo}@{ref}\nFile: {file_path}\nLanguage: {language}\nHeuristic: {rule_id} ({title})\nHint: {hint}\n"
    "Lines: {start_line}-{end_line}\n\nSnippet:\n```\n{snippet}\n```\n"
)
# --- End of fixed values ----------------------------------------------------------------------


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def with_ids(candidates: DataFrame, job_id: Column) -> DataFrame:
    return candidates.withColumn("job_id", job_id).withColumn(
        "id", X.finding_id(F.col("job_id"), F.col("file_path"), F.col("rule_id"), F.col("start_line")))


def default_findings(candidates: DataFrame) -> DataFrame:
    """The finding of a candidate that was not reviewed."""
    return candidates.select(
        "id", "job_id", "repo", "ref", "file_path", "language", "rule_id", "title", "start_line", "end_line", "snippet",
        F.col("hint").alias("reasoning"), F.lit(S.DEFAULT_IMPACT).alias("impact"),
        F.lit(S.DEFAULT_FIX).alias("proposed_fix"), F.col("snippet").alias("proposed_snippet"),
        F.lit(S.DEFAULT_SEVERITY).alias("severity"), F.lit(S.DEFAULT_CONFIDENCE).alias("confidence"),
        F.lit("pending").alias("status"), F.lit("").alias("reviewer_notes"), utc_now().alias("created_at"),
    )


def review_requests(candidates: DataFrame) -> DataFrame:
    """The request text sent out for each candidate."""
    text = X.filled(REQUEST, start_line=F.col("start_line").cast("string"), end_line=F.col("end_line").cast("string"))
    return candidates.select("id", text.alias("request"))


def severity(value: Column) -> Column:
    """A known severity in lower case; anything else is medium."""
    cleaned = F.lower(X.strip(value))
    return F.when(cleaned.isin(S.SEVERITIES), cleaned).otherwise(S.DEFAULT_SEVERITY)


def _is_empty(name: str) -> Column:
    """Whether a JSON field is there and false, null, 0, "", [] or {}; null where it is missing."""
    value = F.try_variant_get("variant", f"$.{name}", "variant")
    text = F.get_json_object("raw_text", f"$.{name}")
    kind = F.schema_of_variant(value)
    return F.when(value.isNotNull(), F.when(kind == "VOID", True)
                  .when(kind == "BOOLEAN", text == "false").when(kind == "STRING", text == "")
                  .when(kind.startswith("ARRAY"), text == "[]").when(kind.startswith("OBJECT"), text == "{}")
                  .otherwise(F.expr(f"try_cast(get_json_object(raw_text, '$.{name}') as double)") == 0))


def parse_answers(answers: DataFrame) -> DataFrame:
    """Read review answers (finding_id, raw, error and perhaps seq) field by field, as text; empty values are null.

    One answer for each finding_id: the one with the highest seq where there is such a column, else the last by text.
    Empty text counts as {}. is_bad marks an answer that cannot be used: an error, text that is not a JSON object,
    or a confidence that is not a number. is_real is false only for the JSON values false, null, 0, "", [] and {}.
    """
    latest = [F.desc("seq")] if "seq" in answers.columns else []
    order = Window.partitionBy("finding_id").orderBy(*latest, F.desc_nulls_last("raw"), F.desc_nulls_last("error"))
    raw = F.coalesce(F.nullif(F.col("raw"), F.lit("")), F.lit("{}"))
    is_object = F.coalesce(F.schema_of_variant("variant").startswith("OBJECT"), F.lit(False))
    fields = [n for n in S.REVIEW_FIELDS if n != "is_real_issue"]
    confidence = F.expr("try_cast(confidence as double)").isNotNull() | F.col("confidence").isin("true", "false")
    return (
        answers.withColumn("nth", F.row_number().over(order)).where("nth = 1")
        .select("finding_id", "error", raw.alias("raw_text"))
        .withColumn("variant", F.try_parse_json("raw_text"))
        .select(
            "finding_id", "error", is_object.alias("is_object"),
            *[F.when(~F.coalesce(_is_empty(n), F.lit(False)), F.get_json_object("raw_text", f"$.{n}")).alias(n) for n in fields],
            (~F.coalesce(_is_empty("is_real_issue"), F.lit(False))).alias("is_real"))
        .select(
            "finding_id", *fields,
            (F.col("error").isNotNull() | ~F.col("is_object") | (F.col("confidence").isNotNull() & ~confidence)).alias("is_bad"),
            "is_real")
    )


def reviewed_findings(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Findings after review: false positives dropped, a failed review keeps the default finding.

    A candidate without an answer counts as failed. Fields missing or empty in an answer come from the candidate.
    """
    parsed = parse_answers(answers).withColumnsRenamed(
        {c: f"a_{c}" for c in S.REVIEW_FIELDS if c != "is_real_issue"})
    joined = default_findings(candidates).join(parsed, F.col("id") == F.col("finding_id"), "left")
    bad = F.coalesce("is_bad", F.lit(True))
    given = lambda name: F.nullif(F.col(f"a_{name}"), F.lit(""))
    confidence = F.expr("try_cast(a_confidence as double)")
    confidence = F.when(F.col("a_confidence") == "true", 1.0).otherwise(confidence)

    def pick(default: str, reviewed: Column) -> Column:
        return F.when(bad, F.col(default)).otherwise(reviewed)

    return (
        joined.where(bad | F.col("is_real"))
        .withColumns({
            "title": pick("title", F.coalesce(given("title"), "title")),
            "reasoning": pick("reasoning", F.coalesce(given("reasoning"), "reasoning")),
            "impact": pick("impact", F.coalesce(given("impact"), F.lit(S.REVIEW_IMPACT))),
            "proposed_fix": pick("proposed_fix", F.coalesce(given("proposed_fix"), F.lit(""))),
            "proposed_snippet": pick("proposed_snippet", F.coalesce(given("proposed_snippet"), "snippet")),
            "severity": pick("severity", severity(F.coalesce("a_severity", F.lit(S.DEFAULT_SEVERITY)))),
            "confidence": pick("confidence", F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(S.REVIEW_CONFIDENCE))),
        })
        .select(*S.FINDINGS.fieldNames())
    )
