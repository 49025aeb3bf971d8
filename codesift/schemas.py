"""Table schemas, enumerations and the rule catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType()}


def _schema(spec: str) -> T.StructType:
    """StructType of "name TYPE, ..."; needs no running session."""
    fields = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


TREE = _schema("repo STRING, ref STRING, path STRING, type STRING, size BIGINT, sha STRING, pos BIGINT")
SOURCE_FILES = _schema("repo STRING, ref STRING, path STRING, sha STRING, size BIGINT, content STRING")
CANDIDATES = _schema(
    "repo STRING, ref STRING, file_path STRING, unit_no INT, language STRING, rule_id STRING, title STRING, "
    "start_line INT, end_line INT, snippet STRING, hint STRING"
)
FINDINGS = _schema(
    "id STRING, job_id STRING, repo STRING, ref STRING, file_path STRING, language STRING, rule_id STRING, "
    "title STRING, start_line INT, end_line INT, snippet STRING, reasoning STRING, impact STRING, "
    "proposed_fix STRING, proposed_snippet STRING, severity STRING, confidence DOUBLE, status STRING, "
    "reviewer_notes STRING, created_at STRING"
)
JOBS = _schema(
    "id STRING, repo STRING, ref STRING, source STRING, created_at STRING, files_scanned INT, "
    "candidates_found INT, findings_count INT"
)
DECISIONS = _schema("finding_id STRING, seq BIGINT, action STRING, notes STRING, proposed_snippet STRING")
# A review answer is read as plain text per field; the casts follow in operators.findings.
REVIEW_FIELDS = (
    "is_real_issue", "title", "severity", "confidence", "reasoning", "impact", "proposed_fix", "proposed_snippet",
)

# --- Fixed values -----------------------------------------------------------------------------
LANGUAGES = ["sql", "python", "spark"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
STATUSES = ["pending", "approved", "rejected", "applied"]

MAX_PER_RULE = 8
MAX_FILE_BYTES = 200_000
MAX_FILES = 200
SNIPPET_RADIUS = 3

SKIP_PARTS = [
    ".git", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", ".tox", "site-packages",
]
SUFFIX_LANGUAGE = {".sql": "sql", ".py": "python", ".scala": "spark"}
SPARK_MARKERS = ["pyspark", "spark.sql", "spark.table", "spark.read"]
SQL_VERBS = ["select", "with", "insert", "update", "delete", "merge"]
MIN_SQL_LENGTH = 20

DEFAULT_IMPACT = "Parser finding. Re-run without --skip-llm for an OpenAI explanation."
DEFAULT_FIX = "Enable OpenAI review to generate a concrete rewrite."
DEFAULT_SEVERITY = "medium"
DEFAULT_CONFIDENCE = 0.55
REVIEW_IMPACT = "Performance"
REVIEW_CONFIDENCE = 0.5

# rule id, title, hint
RULES = [
    ("sql.select_star", "SELECT *", "Selecting every column increases I/O, network, and memory use."),
    ("sql.leading_wildcard_like", "Leading-wildcard LIKE", "LIKE '%value' typically cannot use a B-tree index."),
    ("sql.function_on_column", "Function on filtered column",
     "Wrapping a filtered column in a function often disables index use."),
    ("sql.not_in_subquery", "NOT IN subquery",
     "NOT IN (SELECT ...) is slow, and NULLs can make the predicate match nothing."),
    ("sql.distinct", "SELECT DISTINCT", "DISTINCT often hides a bad join and adds a full sort or hash."),
    ("sql.cross_join", "CROSS JOIN", "A CROSS JOIN builds a cartesian product."),
    ("sql.in_subquery", "IN subquery", "IN (SELECT ...) can be rewritten as a join or semi-join."),
    ("sql.correlated_subquery", "Correlated subquery",
     "This subquery reads columns from an outer query and can run once per outer row."),
    ("sql.order_without_limit", "ORDER BY without LIMIT", "Sorting a full result with no LIMIT is expensive."),
    ("py.pandas_iterrows", "pandas iterrows()",
     "Row-wise pandas iteration is much slower than a vectorized operation."),
    ("py.pandas_itertuples", "pandas itertuples()",
     "itertuples() still walks rows in Python. Prefer a vectorized operation."),
    ("py.pandas_apply", "pandas apply()", "apply() on a pandas object is often a Python loop in disguise."),
    ("py.string_concat_loop", "String concatenation in a loop",
     "Repeated += on a string copies the whole string on every iteration."),
    ("py.nested_same_iterable", "Nested loop over the same collection",
     "Looping over the same collection twice is quadratic."),
    ("py.read_all", "Read entire file into memory",
     "Reading a whole file into memory can be replaced with streaming or chunks."),
    ("py.time_sleep", "time.sleep", "time.sleep stalls the worker. Prefer an event, a queue, or bounded backoff."),
    ("spark.collect", "DataFrame.collect()",
     "collect() pulls the dataset to the driver and can run it out of memory."),
    ("spark.to_pandas", "toPandas()", "toPandas() materializes the DataFrame on the driver."),
    ("spark.count_in_loop", "count() inside a loop",
     "Each DataFrame.count() is a Spark job. Repeated counts are expensive."),
    ("spark.python_udf", "Python UDF", "A Python UDF blocks Catalyst optimization and adds serialization."),
    ("spark.rdd_action", "RDD map instead of DataFrame API",
     "RDD map/flatMap/foreach skips Catalyst and Tungsten."),
    ("spark.coalesce_one", "coalesce(1)", "coalesce(1) forces the write through a single partition."),
    ("spark.cartesian", "Cartesian Spark join",
     "crossJoin or cartesian explodes the number of rows and the shuffle."),
    ("spark.repartition_no_key", "repartition by count only",
     "repartition(n) with no key still shuffles the whole dataset."),
    ("spark.large_take", "Large take()", "take() of thousands of rows concentrates data on the driver."),
]
# --- End of fixed values ----------------------------------------------------------------------

RULE_LANGUAGE = {"sql": "sql", "py": "python", "spark": "spark"}


def rule_catalog(spark: SparkSession) -> DataFrame:
    """The 25-row rule dimension: rule_id, title, hint, language."""
    rows = [(rule, title, hint, RULE_LANGUAGE[rule.split(".")[0]]) for rule, title, hint in RULES]
    return spark.createDataFrame(rows, "rule_id STRING, title STRING, hint STRING, language STRING")
