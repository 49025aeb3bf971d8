"""The whole audit: source files -> hits -> candidates, and the per-file scan report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift import schemas as S
from codesift.functions import text as X
from codesift.operators import rank, rules_py, sqlfacts, units, views
from codesift.operators import tokens as TK

# The rule plans are long chains of projections. Deriving constraints through every alias takes minutes on
# them and finds nothing (there is no outer filter to infer), so it is switched off for the session.
# Generated methods above 8000 bytes are never compiled by the JVM; below that limit Spark splits them up.
# Case mapping through ICU is many times slower per token and gives the same for the words the rules look at.
SESSION_SETTINGS = {
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.icu.caseMappings.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scannable(source_files: DataFrame, num_partitions: int | None = None, lines_only: bool = False) -> DataFrame:
    """Supported files, hash-partitioned once by file_id, which files with equal texts share; lines_only: those with texts
    that give the same lines."""
    configure(source_files.sparkSession)
    return TK.partition_files(source_files.where(X.is_supported(F.col("path"))), num_partitions, lines_only)


def python_hits(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Hits of the Python and Spark rules, or of some. Files without any word that these need are not tokenized."""
    words = rules_py.triggers(rules)
    hits = rules_py.python_hits(TK.one_per_text(files.where(F.col("suffix") == ".py")).where(F.col("content").rlike(words)), rules)
    return _only(hits, rules)


def sql_hits(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Hits of the SQL rules, or of some. Texts without any word that these need are not tokenized."""
    if rules is None:
        return _only(sqlfacts.sql_hits(units.sql_units(files)), rules)
    words = "(?i)" + "|".join(sqlfacts.TRIGGERS[r] for r in rules)
    # in a literal a word may be spelled with an escape or split, so files are only left out by the text of units
    found = units.sql_units(files, words)
    return _only(sqlfacts.sql_hits(found.where(F.col("sql").rlike(words)), rules), rules)


def _only(hits: DataFrame, rules: list[str] | None) -> DataFrame:
    hits = hits.where(F.col("rule_id") != sqlfacts.UNREADABLE) if rules is None else hits.where(F.col("rule_id").isin(rules))
    return hits.drop("why")


def scanned(files: DataFrame, all_files: bool = False) -> DataFrame:
    """Hits of all rules before dedupe and cap, and what cannot be read: file_id, unit_no, rule_id, start_line, end_line, pos,
    why. Rows of the rule `unreadable` have the line and the reason. all_files: those without any word of a rule too."""
    python = TK.one_per_text(files.where(F.col("suffix") == ".py"))
    python = python if all_files else python.where(F.col("content").rlike(rules_py.triggers()))
    return rules_py.python_hits(python).withColumn("pos", F.col("pos").cast("bigint")).unionByName(
        sqlfacts.sql_hits(units.sql_units(files)).withColumns({
            "pos": F.col("pos").cast("bigint"),
            "why": F.when(F.col("rule_id") == sqlfacts.UNREADABLE, "brackets or quotes do not add up")}))


def raw_hits(files: DataFrame) -> DataFrame:
    """Hits of all rules before dedupe and cap: file_id, unit_no, rule_id, start_line, end_line, pos."""
    return _only(scanned(files), None)


def enrich(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Attach path, title, hint and snippet. The catalog has 25 rows, so it is broadcast."""
    catalog = F.broadcast(S.rule_catalog(hits.sparkSession))
    lines = F.when(F.size("hits") > 0, X.split_lines(X.with_number(F.col("content"), F.col("number"))))
    per_file = hits.groupBy("file_id").agg(
        F.collect_list(F.struct("unit_no", "rule_id", "start_line", "end_line")).alias("hits"))
    # both sides lie by file_id already: the hits of a task become its hash table, contents are never sent around
    with_snippet = lambda h: F.struct(
        h["unit_no"].alias("unit_no"), h["rule_id"].alias("rule_id"), h["start_line"].alias("start_line"),
        h["end_line"].alias("end_line"), X.snippet_of(F.col("lines"), h["start_line"], h["end_line"]).alias("snippet"))
    return (
        files.select("file_id", "repo", "ref", "path", "content", "number").join(per_file.hint("shuffle_hash"), "file_id")
        .select("repo", "ref", F.col("path").alias("file_path"), "hits", lines.alias("lines"))
        .select("repo", "ref", "file_path", F.explode(F.transform("hits", with_snippet)).alias("h"))
        .select("repo", "ref", "file_path", "h.*")
        .join(catalog, "rule_id")
        .select(*S.CANDIDATES.fieldNames())
    )


def candidates(source_files: DataFrame, num_partitions: int | None = None,
               max_per_rule: int | None = None) -> DataFrame:
    """All rules over all supported files: the candidates table. max_per_rule keeps the first hits of a rule in a unit."""
    files = scannable(source_files, num_partitions, lines_only=True)
    return enrich(rank.ranked(raw_hits(files), max_per_rule), files)


def unreadable(files: DataFrame) -> DataFrame:
    """Files and SQL units whose brackets or quotes do not add up: file_id, unit_no, open_brackets, bad_quote."""
    python = TK.one_per_text(files.where(F.col("suffix") == ".py")).select("file_id", F.lit(0).alias("unit_no"), "content")
    return TK.lexical_problems(
        python, F.regexp_extract_all("content", F.lit(TK.PY_TOKEN), F.lit(0)), TK.PY_TRIVIA, ["file_id", "unit_no"]
    ).unionByName(unreadable_sql(files))


def unreadable_sql(files: DataFrame) -> DataFrame:
    """SQL units whose brackets or quotes do not add up in any reading."""
    tokens = sqlfacts.lexed(F.col("sql"), F.col("dialect"))
    return TK.lexical_problems(units.sql_units(files), tokens, TK.SQL_TRIVIA, ["file_id", "unit_no"])


def scan_report(source_files: DataFrame, num_partitions: int | None = None,
                max_per_rule: int | None = None) -> DataFrame:
    """One row per scanned file: repo, ref, path, position, total, engine, n_candidates, detail.

    position is the place of the file in its repository, ordered by the parts of its path. Hits and what cannot be read come
    from the same pass over the tokens; detail has the first line that cannot be read and the reason.
    """
    files = scannable(source_files, num_partitions, lines_only=True)
    is_hit = F.col("rule_id") != sqlfacts.UNREADABLE
    counts = rank.ranked(scanned(files, all_files=True), max_per_rule).groupBy("file_id").agg(
        F.count_if(is_hit).cast("int").alias("n"), F.max(is_hit & (F.col("unit_no") > 0)).alias("embedded"),
        F.min(F.when(~is_hit, F.struct("unit_no", "start_line", "why"))).alias("problem"))
    reason = F.concat(
        F.lit("unreadable: line "), F.col("problem.start_line").cast("string"), F.lit(": "), F.col("problem.why"))
    n = F.coalesce("n", F.lit(0))
    places = views.numbered(files.select("file_id", "repo", "ref", "path", "suffix"), ["repo", "ref"])
    return (
        places.join(counts, "file_id", "left")
        .select(
            "repo", "ref", "path", "position", "total",
            F.when((F.col("suffix") == ".py") & F.col("embedded"), "tokens+sql").otherwise("tokens").alias("engine"),
            n.alias("n_candidates"),
            F.when((n == 0) & reason.isNotNull(), reason).when(n == 0, "no issues").otherwise("").alias("detail"),
        )
    )


def summary(source_files: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Job summary of a scan whose candidates all become findings: repo, ref, files_scanned, candidates_found, findings_count.

    Files and hits are counted in one grouping; the audit is planned and run once, and no snippet is made.
    """
    files = scannable(source_files, num_partitions, lines_only=True)
    # hits are counted beside their files, where both lie already
    per_file = rank.ranked(raw_hits(files)).groupBy("file_id").agg(F.count("*").alias("hits"))
    counted = files.select("file_id", "repo", "ref").join(per_file.hint("shuffle_hash"), "file_id", "left")
    hits = F.coalesce(F.sum("hits"), F.lit(0)).cast("int")
    return counted.groupBy("repo", "ref").agg(
        F.count("*").cast("int").alias("files_scanned"), hits.alias("candidates_found"), hits.alias("findings_count"))
