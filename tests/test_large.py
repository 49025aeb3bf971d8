"""What keeps the work of a task bounded: partitions by text, time in proportion to a text."""

import time

from pyspark.sql import functions as F

from codesift.corpus import code_corpus
from codesift.operators import sqlfacts
from codesift.plans.derived import Tables


def test_partitions_by_text(spark, tmp_path):
    """A partition of the derived files has about 2 MB of text, however many cores there are."""
    spark.range(400_000).select(
        F.col("id").alias("o_orderkey"), (F.rand(1) * 15000).cast("bigint").alias("o_custkey"),
        F.rand(2).alias("o_totalprice")).write.parquet(str(tmp_path / "orders.parquet"))
    t = Tables(spark, str(tmp_path))
    text = code_corpus(t.orders).agg(F.sum("size")).first()[0]
    assert text / t.partitions("orders") < 2.5 * 2**20


def test_hashes_of_a_text_in_linear_time(spark):
    """Three times as many hash signs in a SQL text take about three times as long."""
    def seconds(n):
        text = "SELECT a FROM t # it's\n" * n
        units = spark.createDataFrame([(1, 0, "sql", 1, text)], "file_id int, unit_no int, dialect string, start_line int, sql string")
        start = time.time()
        assert sqlfacts.sql_tokens(units).agg(F.max("eline")).first()[0] == n + 1
        return time.time() - start

    seconds(10)
    assert seconds(2_400) < 4 * seconds(800) + 1
