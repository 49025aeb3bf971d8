"""Dedupe and cap of raw hits. All windows start with file_id, so no hit is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift import schemas as S


def dedupe_unit(hits: DataFrame) -> DataFrame:
    """One hit per (rule, start line) of a unit; of several the one that ends last is kept."""
    order = Window.partitionBy("file_id", "unit_no", "rule_id", "start_line").orderBy(F.desc("end_line"), "pos")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def cap_per_rule(hits: DataFrame, limit: int | None = S.MAX_PER_RULE) -> DataFrame:
    """The first `limit` hits of a rule in a unit, by line; all of them without a limit."""
    if limit is None:
        return hits
    order = Window.partitionBy("file_id", "unit_no", "rule_id").orderBy("start_line", "pos")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("nth")


def dedupe_file(hits: DataFrame) -> DataFrame:
    """One hit per (rule, start line) of a file; the earliest unit is kept."""
    order = Window.partitionBy("file_id", "rule_id", "start_line").orderBy("unit_no", "pos")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def ranked(hits: DataFrame, max_per_rule: int | None = None) -> DataFrame:
    """One hit per rule and line of a file, the first max_per_rule of a unit where that is asked for."""
    return dedupe_file(cap_per_rule(dedupe_unit(hits), max_per_rule))
