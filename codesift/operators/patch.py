"""Approved rewrites folded into files, and the report on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions import text as X

# --- Fixed values: report text ----------------------------------------------------------------
REPORT_INTRO = [
    "This pull request was opened **after a human approved** the findings below.",
    "",
    "The agent scanned SQL, Python, and Spark files, asked OpenAI for reasoning and",
    "severity, and only applied snippets that a reviewer signed off on.",
    "",
    "| Severity | File | Finding |",
    "| --- | --- | --- |",
]
REPORT_ROW = "| {severity} | `{file_path}:{start_line}` | {title} |"
REPORT_SECTION = [
    "### {title} (`{file_path}`)",
    "",
    "- Severity: `{severity}` (confidence {confidence})",
    "- Impact: {impact}",
    "- Why: {reasoning}",
    "- Fix: {proposed_fix}",
    "",
]
REPORT_MIDDLE = ["", "## Reasoning", ""]
REPORT_END = ["Please still treat this as a suggested patch and run tests before merge."]
# --- End of fixed values ----------------------------------------------------------------------

def replace_first(content: Column, snippet: Column, rewrite: Column) -> Column:
    """Replace the first occurrence; an empty snippet matches at the start."""
    at = F.position(snippet, content)
    return F.concat(
        F.substring(content, F.lit(1), at - 1), rewrite,
        F.substring(content, at + F.length(snippet), F.length(content)))


def replace_lines(content: Column, start_line: Column, end_line: Column, rewrite: Column) -> Column:
    """Replace lines start..end by the lines of the rewrite; a final line break is kept."""
    lines = X.split_lines(content)
    start = F.greatest(start_line - 1, F.lit(0))
    end = F.least(end_line, F.size(lines))
    tail = F.greatest(F.size(lines) - F.greatest(end, F.lit(0)), F.lit(0))
    joined = F.array_join(
        F.concat(F.slice(lines, F.lit(1), start), X.split_lines(rewrite),
                 F.slice(lines, F.greatest(end, F.lit(0)) + 1, tail)), "\n")
    return F.concat(joined, F.when(content.endswith("\n"), "\n").otherwise(""))


def apply_snippet(content: Column, f: Column) -> Column:
    """One finding applied to a text: the reviewed snippet where it stands, else its lines."""
    found = (F.position(f["snippet"], content) > 0) | (f["snippet"] == "")
    return F.when(found, replace_first(content, f["snippet"], f["proposed_snippet"])).otherwise(
        replace_lines(content, f["start_line"], f["end_line"], f["proposed_snippet"]))


def patched_files(approved: DataFrame, source_files: DataFrame) -> DataFrame:
    """Each file with approved findings once: repo, ref, path, content, n_applied, overlap.

    Findings are applied from the bottom up (ties by id). A file is a chain of edits: they are collected beside its text
    and folded in one pass. The group is bounded by the file: two findings of a rule never start in the same line.
    """
    keys = ["repo", "ref", "path"]
    order = Window.partitionBy(*keys).orderBy(F.desc("start_line"), "id")
    edits = approved.withColumnRenamed("file_path", "path").select(
        *keys, "start_line", "end_line", "snippet", "proposed_snippet", F.row_number().over(order).alias("nth"),
        F.coalesce(F.lag("start_line").over(order) <= F.col("end_line"), F.lit(False)).alias("overlap"),
    ).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("nth", "start_line", "end_line", "snippet", "proposed_snippet"))).alias("edits"),
        F.count("*").cast("int").alias("n_applied"), F.max("overlap").alias("overlap"))
    folded = F.aggregate("edits", F.col("content"), apply_snippet)
    # the edits, not the contents, become the hash table of a task; contents are never broadcast
    return source_files.select(*keys, "content").join(edits.hint("shuffle_hash"), keys).select(
        *keys, folded.alias("content"), "n_applied", "overlap")


def report_lines(findings: DataFrame) -> DataFrame:
    """The report of each (repo, job) as lines: repo, job_id, part, id, line, text.

    Ordered by (part, id, line) the text column is the report. It stays a table of lines: a report over millions
    of findings is sorted and written by many tasks and never becomes one value.
    """
    scope = findings.select("repo", "job_id").distinct()

    def fixed(part: int, texts: list[str]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(t).alias("text")) for i, t in enumerate(texts)])
        return scope.select("repo", "job_id", F.lit(part).alias("part"), F.lit("").alias("id"), F.inline(rows))

    shown = {"start_line": F.col("start_line").cast("string"), "confidence": F.format_string("%.2f", "confidence")}
    row = X.filled(REPORT_ROW, **shown)
    section = [X.filled(x, **shown) for x in REPORT_SECTION]
    per_finding = F.array(
        F.struct(F.lit(2).alias("part"), F.lit(0).alias("line"), row.alias("text")),
        *[F.struct(F.lit(4).alias("part"), F.lit(i).alias("line"), t.alias("text")) for i, t in enumerate(section)],
    )
    body = findings.select("repo", "job_id", "id", F.inline(per_finding)).select(
        "repo", "job_id", "part", "id", "line", "text")
    return (
        fixed(1, REPORT_INTRO).unionByName(body).unionByName(fixed(3, REPORT_MIDDLE)).unionByName(fixed(5, REPORT_END))
    )


def write_report(findings: DataFrame, path: str) -> None:
    """Write the reports as text, one directory per repository and job, parts in reading order."""
    report_lines(findings).orderBy("repo", "job_id", "part", "id", "line").select("repo", "job_id", "text").write.mode(
        "overwrite").partitionBy("repo", "job_id").text(path)
