"""Quality rules: one table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ends a word, and the characters that count as symbols.
BLANKS = " \t-\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the tables.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que pour est dans qui par au sur pas avec "
    "el y los se las del por con no una su para al es lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if numerator < at_least * denominator or numerator > at_most * denominator."""

    name: str
    numerator: str
    denominator: str | None = None
    at_least: int | None = None
    at_most: int | None = None
    scale: int = 1
    base: bool = False


#: scale * numerator is held against bound * denominator, all in whole numbers: no rounding anywhere.
RULES = (
    Rule("too_few_words", "n_words", at_least=50, base=True),
    Rule("repeated_words", "n_repeat_words", "n_words", at_most=50, scale=100, base=True),
    Rule("word_length", "word_chars", "n_words", at_least=2, at_most=12),
    Rule("symbols", "n_symbols", "n_words", at_most=10, scale=100),
    Rule("stop_words", "n_stop_words", "n_words", at_least=1, scale=100),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=40, scale=100),
)


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), "")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (struct of all columns of docs) and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_stop_words, all long.

    Null and empty texts count 0 everywhere; every row gives one row, repeated ones too; an empty table stays empty.
    Repeated 3-word windows: windows sorted by (hash, place) have their equals as neighbours; the places, sorted again,
    each cover three words less what the place before covers already. Only texts that repeat a window are sorted.
    """
    grams = F.when(F.size("w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("w") - 3),
        lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]"))
    placed = F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = F.sort_array(F.transform(
        F.filter("p", lambda x, k: (x["h"] == F.get("p", k - 1)["h"]) | (x["h"] == F.get("p", k + 1)["h"])),
        lambda x: x["i"]))
    covered = F.when(F.size("s") > 0, F.aggregate(
        F.sequence(F.lit(0), F.size("s") - 1), F.lit(0),
        lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get("s", k) - F.get("s", k - 1), F.lit(3)))))
    base = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return (
        base.select("row", "t", words(F.col("t")).alias("w"), lines.alias("l"))
        .select("row", "t", "w", "l", grams.alias("h"))
        .select("row", "t", "w", "l", placed.alias("p"))
        .select("row", "t", "w", "l", twice.alias("s"))
        .select(
            "row",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            (F.size(F.split("t", f"[{SYMBOLS}]", -1)) - 1).cast("long").alias("n_symbols"),
            F.size("l").cast("long").alias("n_lines"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            # the condition is always true and keeps filters above this projection: pushed below, they would carry the
            # expressions of whole columns into the lambdas, to be computed anew for each word
            F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0))).cast("long").alias("n_repeat_words"),
            F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )
    )


def failed(rule: Rule) -> Column:
    """True where the rule rejects; a text without words has nothing to reject but its length."""
    top = F.col(rule.numerator) * rule.scale
    bottom = F.col(rule.denominator) if rule.denominator else F.lit(1)
    low = top < bottom * rule.at_least if rule.at_least is not None else F.lit(False)
    high = top > bottom * rule.at_most if rule.at_most is not None else F.lit(False)
    return low | high


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """statistics() and base_failed, kept (boolean), failed_rules (names, in the order of the table).

    base_failed: a base rule rejects. kept: no rule rejects; never null. An empty table of rules keeps all rows.
    """
    names = F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules]).cast("array<string>"))
    base = [failed(r) for r in rules if r.base] or [F.lit(False)]
    any_base = base[0]
    for one in base[1:]:
        any_base = any_base | one
    return statistics(docs, text).select("*", any_base.alias("base_failed"), names.alias("failed_rules")).select(
        "*", (F.size("failed_rules") == 0).alias("kept"))


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    return judged(docs, text, rules).filter("kept").select("row.*")
