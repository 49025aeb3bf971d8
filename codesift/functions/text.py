"""Small text expressions shared by the operators. All are built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift import schemas as S

LINE_BREAK = r"\r\n|\r|\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, however often and in whatever lambda body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every whitespace character, not spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unify_newlines(text: Column) -> Column:
    """Text as the rules see it: \\n is the only line break."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a final break does not open another line; empty text has no line."""
    lines = F.split(text, LINE_BREAK, -1)
    ends_open = text.endswith("\n") | text.endswith("\r") | (text == "")
    return F.when(ends_open, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def snippet(content: Column, start_line: Column, end_line: Column, radius: int = S.SNIPPET_RADIUS) -> Column:
    """Lines start-radius .. end+radius of the file, clamped to the file."""
    return snippet_of(split_lines(content), start_line, end_line, radius)


def snippet_of(lines: Column, start_line: Column, end_line: Column, radius: int = S.SNIPPET_RADIUS) -> Column:
    lo = F.greatest(F.lit(0), start_line - 1 - radius)
    hi = F.least(F.size(lines), F.greatest(end_line, start_line) + radius)
    return F.array_join(F.slice(lines, lo + 1, F.greatest(hi - lo, F.lit(0))), "\n")


def looks_like_sql(text: Column) -> Column:
    """True when the text opens with a statement verb and is long enough to be a statement."""
    body = strip(F.regexp_replace(strip(text), r"^\(+", ""))
    verb = F.lower(F.regexp_extract(body, r"^(\S+)", 1))
    return (F.length(body) >= S.MIN_SQL_LENGTH) & verb.isin(S.SQL_VERBS)


def filled(text: str, **columns: Column) -> Column:
    """A text with the columns it names in braces: those given, else those of that name."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[columns.get(p, F.col(p)) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def path_suffix(path: Column) -> Column:
    """Lower-cased last suffix of the file name; a name with only a leading dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def in_skipped_dir(path: Column) -> Column:
    """True when any part of the path is a vendor or build name."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in S.SKIP_PARTS]))


def is_supported(path: Column) -> Column:
    return path_suffix(path).isin(list(S.SUFFIX_LANGUAGE)) & ~in_skipped_dir(path)


def classify(path: Column, content: Column) -> Column:
    """sql / python / spark, or NULL for a suffix the audit does not read."""
    suffix = path_suffix(path)
    marked = content.rlike("(?i)" + "|".join(m.replace(".", r"\.") for m in S.SPARK_MARKERS))
    return (
        F.when(suffix == ".sql", "sql")
        .when(suffix == ".scala", "spark")
        .when((suffix == ".py") & marked, "spark")
        .when(suffix == ".py", "python")
    )


def text_id(*parts: Column | str) -> Column:
    """128-bit key of a text and what goes with it. One short binary column keeps the token rows small."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    # nulls are told from empty texts
    return F.substring(F.unhex(F.sha2(F.concat_ws(
        "\u0001", *[F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c)) for c in columns]), 256)), 1, 16)


def split_number(text: Column) -> Column:
    """text and number of a struct: the text with zeros for the one number that ends words in it, such as the 2024 of sales_2024 and region_2024.

    Other texts stay as they are: those with several such numbers, and those where the number or as many zeros stand anywhere
    else. So words of a text are equal after it if and only if they were before, and every place stays. Words behind a
    backslash or a decimal point are none, they may be part of an escape or a number; nor are numbers below three digits, and
    texts with a number in the name of a character (\\N{...}) stay too, and have no number then. with_number() undoes it.
    """
    none = F.lit(None).cast("string")
    parts = lambda t, n: F.struct(t.alias("text"), n.alias("number"))
    ends = r"[0-9]{3,}+(?!\w)(?<=(?<![\\\w])(?<![0-9]\.)[A-Za-z_]{1,60}[0-9]{3,18})"  # digits are looked for first

    def replaced(runs: Column, found: Column) -> Column:
        number = F.get(found, F.lit(0))
        zeros = F.repeat(F.lit("0"), F.length(number))
        alone = ((F.size(F.array_distinct(found)) == 1) & ~F.array_contains(runs, zeros)
                 & (F.size(F.array_remove(runs, number)) == F.size(runs) - F.size(found)))
        return F.when(alone, parts(F.regexp_replace(text, F.lit(ends), zeros), number)).otherwise(parts(text, none))

    runs = F.regexp_extract_all(text, F.lit("[0-9]{3,}+"), F.lit(0))
    return let(runs, lambda r: F.when(
        (F.size(r) > 0) & ~text.rlike(r"\\N\{[^}]*[0-9]"),
        let(F.regexp_extract_all(text, F.lit(ends), F.lit(0)), lambda f: replaced(r, f))).otherwise(parts(text, none)))


def without_number(text: Column) -> Column:
    """The text of split_number()."""
    return split_number(text)["text"]


def with_number(text: Column, number: Column) -> Column:
    """A text of split_number(), or whole tokens or lines of one, with its number again."""
    zeros = F.concat(F.lit("(?<![0-9])0{"), F.length(number).cast("string"), F.lit("}(?![0-9])"))
    return F.when(number.isNotNull() & F.contains(text, F.lit("000")), F.regexp_replace(text, zeros, number)).otherwise(text)


def finding_id(job_id: Column, file_path: Column, rule_id: Column, start_line: Column) -> Column:
    """Stable id of a finding: (rule, line, file) is unique within a job, so a rerun gives the same id."""
    return F.sha2(F.concat_ws("\u0001", job_id, file_path, rule_id, start_line.cast("string")), 256)
