"""Audit tables derived from the benchmark tables, so that every query's work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The parquet tables of one scale factor and the audit tables made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def partitions(self, table: str, growth: int = 16, mb: int = 4) -> int:
        """Partitions for the files made from a table: one per so many MB of text, taken as growth times the table's size in
        its files, and one per core at least. The size is the optimizer's, from the listing.

        All sorts of a task are held at once, in 130 to 210 bytes for each byte of text: beyond a few MB they spill, each
        stage anew. An order of 10 to 18 bytes becomes a file of about 136.
        """
        plan = getattr(self, table)._jdf.queryExecution().optimizedPlan()
        size = int(str(plan.stats().sizeInBytes()))
        # a table whose rows repeat takes little in its files: those of orders are counted, in their footers
        text = max(growth * size, 136 * self.orders.count()) if table == "orders" else growth * size
        return max(self.spark.sparkContext.defaultParallelism, text // (mb << 20))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def tree(self) -> DataFrame:
        """A file listing: one entry per document."""
        return self.documents.selectExpr(
            "lang AS repo", "'main' AS ref",
            "concat(source, '/', element_at(array('src','node_modules','dist','lib','.venv','build.d'), "
            "cast(doc_id % 6 as int) + 1), '/', doc_id, "
            "element_at(array('.sql','.py','.scala','.PY','.txt'), cast(doc_id % 5 as int) + 1)) AS path",
            "if(doc_id % 7 = 0, 'tree', 'blob') AS type", "if(doc_id % 11 = 0, NULL, n_chars) AS size",
            "concat('s', doc_id) AS sha", "doc_id AS pos",
        )

    @property
    def blobs(self) -> DataFrame:
        """Fetched contents; every 13th fetch failed and has no row."""
        return self.tree.join(self.documents.select(F.col("doc_id").alias("pos"), F.col("text").alias("content")), "pos"
                              ).where("pos % 13 <> 0").select("repo", "ref", "path", "content")

    @property
    def findings(self) -> DataFrame:
        """One finding per order."""
        return self.orders.selectExpr(
            "cast(o_orderkey as string) AS id", "concat('job', o_custkey % 20) AS job_id",
            "concat('repo_', o_custkey % 10) AS repo", "'main' AS ref",
            "concat('src/m', o_orderkey % 100, '.py') AS file_path", "'spark' AS language",
            "'spark.collect' AS rule_id", "concat('Finding ', o_orderkey % 25) AS title",
            "cast(o_orderkey % 50 + 1 as int) AS start_line", "cast(o_orderkey % 50 + 2 as int) AS end_line",
            "'x.collect()' AS snippet", "repeat('word ', cast(o_orderkey % 60 as int)) AS reasoning",
            "'driver' AS impact", "'use limit' AS proposed_fix", "'x.limit(10)' AS proposed_snippet",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' "
            "WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity",
            "cast((o_orderkey % 101) / 100.0D as double) AS confidence",
            "CASE WHEN o_orderkey % 13 = 0 THEN 'applied' WHEN o_orderstatus = 'O' THEN 'pending' "
            "WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS status",
            "'' AS reviewer_notes", "date_format(o_orderdate, 'yyyy-MM-dd') AS created_at",
        )

    @property
    def jobs(self) -> DataFrame:
        """One job per customer."""
        return self.customer.selectExpr(
            "cast(c_custkey as string) AS id", "c_name AS repo", "'main' AS ref",
            "if(c_nationkey % 2 = 0, 'github', 'local') AS source", "'2024-01-01' AS created_at",
            "cast(c_custkey % 5 as int) AS files_scanned", "cast(c_custkey % 9 as int) AS candidates_found",
            "cast(c_custkey % 7 as int) AS findings_count",
        )

    @property
    def decisions(self) -> DataFrame:
        """One decision per event; many are on unknown findings or unknown actions."""
        return self.events.selectExpr(
            "cast(user_id * 200 as string) AS finding_id", "event_id AS seq",
            "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE event_type END AS action",
            "props AS notes",
            "if(event_id % 3 = 0, ' ', cast(cast(floor(value * 100) as bigint) as string)) AS proposed_snippet",
        )

    @property
    def review_candidates(self) -> DataFrame:
        """One candidate per document."""
        return self.documents.selectExpr(
            "cast(doc_id as string) AS id", "'job' AS job_id", "lang AS repo", "'main' AS ref",
            "concat(source, '.py') AS file_path", "'python' AS language", "'py.time_sleep' AS rule_id",
            "'time.sleep' AS title", "cast(doc_id % 9 + 1 as int) AS start_line",
            "cast(doc_id % 9 + 1 as int) AS end_line", "text AS snippet", "concat('hint ', source) AS hint",
        )

    @property
    def review_answers(self) -> DataFrame:
        """One answer per labelled document, in six shapes; some calls failed."""
        return self.labels.selectExpr(
            "cast(doc_id as string) AS finding_id",
            """CASE doc_id % 6
               WHEN 0 THEN concat('{"is_real_issue": true, "title": "Real ', doc_id,
                                  '", "severity": " HIGH ", "confidence": 0.9}')
               WHEN 1 THEN concat('{"is_real_issue": ', quality, ', "confidence": 0, "severity": "bogus"}')
               WHEN 2 THEN 'not json'
               WHEN 3 THEN ''
               WHEN 4 THEN '{"is_real_issue": "false", "reasoning": "", "impact": "cost", "proposed_fix": "rewrite", "proposed_snippet": "x"}'
               ELSE '{"is_real_issue": false}' END AS raw""",
            "if(doc_id % 17 = 0, 'timeout', NULL) AS error",
        )

    @property
    def document_lines(self) -> DataFrame:
        """Lines of the documents as raw hits: the rule of a line is its first word."""
        return self.documents.select(
            F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n", -1)).alias("line", "text"),
        ).select(
            "file_id", F.lit(0).alias("unit_no"), F.regexp_extract("text", r"^(\S*)", 1).alias("rule_id"),
            F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.col("line").cast("bigint").alias("pos"),
        )
