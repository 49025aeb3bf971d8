"""Connected components of a link table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm import rows


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node it knows.

    Least nodes are written before the join: so both sides of it are plain exchanges, and the adaptive plan splits the
    neighbours of a centre with very many of them.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = rows.checkpointed(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
    return both.filter("b > a").join(least, F.col("a") == F.col("n")).select(
        F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. links: a < b."""
    least = rows.checkpointed(links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m"))
    joined = links.join(least, F.col("b") == F.col("n"))
    return joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(
        joined.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: each linked node and the least node it reaches. links: a, b of one orderable type.

    Large and small stars take turns, each a partial aggregation and a join on the node, until the links no longer
    change; a count and a sum of hashes tell that, so that no link reaches the driver. Links to oneself are dropped.
    """
    links = rows.checkpointed(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = tuple(links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first())
        if now == before or now[0] == 0:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(
                links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
        links = rows.checkpointed(_small_star(rows.checkpointed(_large_star(links))))
