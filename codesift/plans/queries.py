"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift import schemas as S
from codesift.corpus import code_corpus, text_corpus
from codesift.functions import text as X
from codesift.operators import findings as N
from codesift.operators import patch, rank, rules_py, sqlfacts, state, units, views
from codesift.operators import tokens as TK
from codesift.operators import pyfacts as P
from codesift.plans import audit
from codesift.plans.derived import Tables
from codesift.sources import files as SF
from codesift.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a query under its name; it gets the tables of a scale factor."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(audit.configure(spark), sf_dir))
    return fn


# --- corpus: rules ----------------------------------------------------------------------------

def corpus(t: Tables) -> DataFrame:
    # a task that makes files writes the texts of eight that read them
    return code_corpus(t.orders, max(t.spark.sparkContext.defaultParallelism, t.partitions("orders") // 8))


def shared_partitions(t: Tables) -> int:
    """Partitions where texts that differ by a number are read once: a task holds the tokens of the templates, however many
    files it has, and much of its time goes into its many small sorts."""
    return t.partitions("orders", mb=32)


def files(t: Tables, lines_only: bool = False) -> DataFrame:
    return audit.scannable(corpus(t), shared_partitions(t) if lines_only else t.partitions("orders"), lines_only)


def with_path(rows: DataFrame, f: DataFrame) -> DataFrame:
    """The path of each row's files, and the number of their texts. Both sides lie by file_id; the rows, not the files, become
    the hash table."""
    return f.select("file_id", "repo", F.col("path").alias("file_path"), "number").join(rows.hint("shuffle_hash"), "file_id").drop("file_id")


def rule_query(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = files(Tables(spark, sf_dir), lines_only=True)
        hits = (audit.sql_hits if rule_id.startswith("sql.") else audit.python_hits)(f, [rule_id])
        hits = rank.ranked(hits)
        return with_path(hits, f).select("repo", "file_path", "start_line", "end_line")

    return run


for _rule, _, _ in S.RULES:
    _name = "rule_" + _rule.split(".")[1].replace("pandas_iter", "iter")
    QUERIES[_name] = rule_query(_rule)


# --- corpus: tokens and facts -----------------------------------------------------------------

def py_files(t: Tables, lines_only: bool = False) -> DataFrame:
    return files(t, lines_only).where(F.col("suffix") == ".py")


def named(name: str):
    """A name as it stands in the file: texts that differ by a number in their names are read once."""
    return X.with_number(F.col(name), F.col("number"))


def line_int(name: str = "line"):
    return F.col(name).cast("int").alias("line")


@query
def py_string_literals(t):
    f = py_files(t)
    return with_path(units.python_literals(f), f).select("file_path", "start_line", "text")


@query
def scala_string_literals(t):
    f = files(t).where(F.col("suffix") == ".scala")
    return with_path(units.scala_literals(f), f).select("file_path", "start_line", "text")


@query
def sql_units(t):
    f = files(t)
    return with_path(units.sql_units(f), f).select("file_path", "start_line", "dialect", "sql")


@query
def sql_statements(t):
    f = files(t, lines_only=True)
    tokens = sqlfacts.sql_tokens(units.sql_units(f).withColumn("unit_line", F.col("start_line")))
    first = units.sql_units(f).select("file_id", "unit_no", "start_line")
    n = (tokens.where((F.col("kind") != "end") & ~F.col("ends")).groupBy("file_id", "unit_no")
         .agg(F.count_distinct("stmt").alias("n_statements")))
    return with_path(n.join(first, ["file_id", "unit_no"]), f).select("file_path", "start_line", "n_statements")


@query
def comment_mask(t):
    """Words seen by the rules: those in comments and strings are not counted."""
    f = files(t, lines_only=True)
    sql = sqlfacts.sql_tokens(units.sql_units(f)).where(F.col("u") == "SELECT").select("file_id", F.col("u").alias("word"))
    py = TK.readable(TK.python_tokens(f.where(F.col("suffix") == ".py"))).where(
        (F.col("kind") == "name") & F.col("tok").isin("collect", "toPandas") & (F.col("p1") == ".")
    ).select("file_id", F.col("tok").alias("word"))
    n = sql.unionByName(py).groupBy("file_id", "word").agg(F.count("*").alias("n"))
    return with_path(n, f).select("file_path", "word", "n")


@query
def sql_clause_context(t):
    f = files(t, lines_only=True)
    return with_path(sqlfacts.clause_context(units.sql_units(f)), f).select("file_path", "line", "op", "in_filter")


@query
def py_imports(t):
    f = py_files(t, lines_only=True)
    rows = P.name_rows(P.nested_pairs(rules_py.python_lines(f))).where(F.col("etype") == "import")
    return with_path(rows, f).select("file_path", named("name").alias("name"), named("module").alias("module"))


@query
def py_bindings(t):
    f = py_files(t, lines_only=True)
    return with_path(P.tagged_bindings(rules_py.python_names(f)), f).select("file_path", "line", named("name").alias("name"), "tag")


@query
def py_scopes(t):
    f = py_files(t, lines_only=True)
    n = F.size(F.filter("blocks", lambda b: b["head"] == "def"))
    return with_path(rules_py.python_lines(f).withColumn("n_defs", n).where("n_defs > 0"), f).select(
        "file_path", line_int(), "n_defs")


@query
def py_loop_depth(t):
    f = py_files(t, lines_only=True)
    return with_path(rules_py.python_lines(f).where("loop_depth > 0"), f).select("file_path", line_int(), "loop_depth")


def methods(f: DataFrame) -> DataFrame:
    uses = P.resolved_uses(rules_py.python_names(f)).where(F.col("etype") == "method")
    return with_path(uses, f).withColumn("method", F.col("name")).withColumn("root", named("asked"))


@query
def py_file_handles(t):
    return methods(py_files(t, lines_only=True)).where((F.col("method") == "read") & F.col("is_handle")).select(
        "file_path", line_int(), F.col("root").alias("name"))


@query
def py_chain_roots(t):
    return methods(py_files(t, lines_only=True)).select("file_path", line_int(), "method", "root")


@query
def py_calls(t):
    return methods(py_files(t, lines_only=True)).where("int_arg IS NOT NULL").select("file_path", line_int(), "method", "int_arg")


@query
def lex_status(t):
    f = files(t, lines_only=True)
    return with_path(audit.unreadable(f), f).select("file_path", "unit_no", "open_brackets", "bad_quote")


# --- corpus: candidates to patched files ------------------------------------------------------

@query
def candidates_all(t):
    f = files(t, lines_only=True)
    return with_path(rank.ranked(audit.raw_hits(f)), f).select("repo", "file_path", "rule_id", "start_line", "end_line")


@query
def candidates_on_text(t):
    """All rules over the texts of documents in comments and literals: only the statement behind them gives a hit."""
    f = audit.scannable(text_corpus(t.documents), t.partitions("documents", 8, 32))
    return with_path(rank.ranked(audit.raw_hits(f)), f).select("repo", "file_path", "rule_id", "start_line", "end_line")


@query
def candidates_enriched(t):
    return audit.candidates(corpus(t), shared_partitions(t)).drop("unit_no")


def corpus_findings(t: Tables) -> DataFrame:
    return N.default_findings(N.with_ids(audit.candidates(corpus(t), shared_partitions(t)), F.lit("job1")))


@query
def default_findings(t):
    return corpus_findings(t).select(
        "id", "job_id", "repo", "file_path", "rule_id", "title", "start_line", "reasoning", "impact", "proposed_fix",
        "severity", "confidence", "status")


@query
def job_summary(t):
    return audit.summary(corpus(t), shared_partitions(t))


@query
def job_rows(t):
    docs = t.documents.select(F.col("lang").alias("repo"), F.lit("main").alias("ref"))
    found = N.reviewed_findings(t.review_candidates, t.review_answers)
    summary = views.job_summary(docs, t.review_candidates, found)
    return views.job_rows(summary, F.concat(F.lit("job-"), "repo"), F.lit("local"), F.lit("2024-01-01"))


@query
def scan_report(t):
    return audit.scan_report(corpus(t), shared_partitions(t)).select("repo", "path", "position", "total", "engine", "n_candidates", "detail")


@query
def scan_summary(t):
    return corpus_findings(t).select("repo", "severity", views.place().alias("place"), "title")


@query
def patched_files(t):
    """Files with none, one, three (each on the line of the next one, too) and up to forty edits, by their number."""
    source = corpus(t)
    kind = F.regexp_extract("path", r"f(\d+)\.", 1).cast("bigint") % 4
    lines = F.size(X.split_lines(F.col("content")))
    n = F.when(kind == 1, 1).when(kind == 2, F.least(F.lit(3), lines)).when(kind == 3, F.least(F.lit(40), lines))
    one = F.when(F.contains("content", F.lit("SELECT *")), "SELECT id").otherwise("PATCH")
    edits = source.withColumns({"kind": kind, "n": n}).where(F.col("n") > 0).select(
        "repo", "ref", "path", "kind", one.alias("one"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    approved = edits.select(
        "repo", "ref", F.col("path").alias("file_path"), F.lpad(F.col("line").cast("string"), 2, "0").alias("id"),
        F.col("line").alias("start_line"), (F.col("line") + F.when(F.col("kind") == 2, 1).otherwise(0)).alias("end_line"),
        F.when(F.col("kind") == 1, "SELECT *").otherwise("not in any file").alias("snippet"),
        F.when(F.col("kind") == 1, F.col("one")).otherwise(F.concat(F.lit("L"), F.col("line"))).alias("proposed_snippet"))
    return patch.patched_files(approved, source).select("repo", "path", "content", "n_applied", "overlap")


@query
def findings_store(t):
    """All findings saved, those of some decided ones saved again, and the table read back."""
    path = store.shared_path(t.spark, "findings")
    store.save_findings(t.findings, path)
    again = t.findings.where(F.expr("id % 3 = 0 AND job_id < 'job15'")).withColumns(
        {"status": F.lit("applied"), "reviewer_notes": F.concat(F.lit("by "), "id")})
    store.save_findings(again, path)
    return store.load_findings(t.spark, path).select("id", "job_id", "repo", "title", "status", "reviewer_notes", "confidence")


# --- tables: sources and filters --------------------------------------------------------------

@query
def filter_skip_dirs(t):
    return t.tree.where(~X.in_skipped_dir(F.col("path"))).select("path")


@query
def filter_suffix(t):
    return t.tree.where(X.is_supported(F.col("path"))).select("path")


@query
def tree_filter(t):
    return SF.listed_files(t.tree, 2000).select("repo", "path", "size")


@query
def tree_cap(t):
    return SF.cap_files(SF.listed_files(t.tree, 2000), 20).select("repo", "path", "pos")


@query
def src_snapshot_join(t):
    return SF.snapshot_files(t.tree, t.blobs).select("repo", "path", "sha", "content")


@query
def src_union(t):
    remote = t.documents.select(F.col("lang").alias("repo"), F.col("doc_id").cast("string").alias("path"))
    local = t.pages.select(F.lit("").alias("repo"), F.col("page_id").cast("string").alias("path"))
    return SF.union_sources(remote, local, "pages").select("source", "repo", "path")


@query
def classify_language(t):
    marked = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("FROM PySpark import x\n"), "text")).otherwise(F.col("text"))
    docs = t.documents.select(F.col("doc_id").alias("pos"), "text")
    return t.tree.join(docs, "pos").select("path", X.classify(F.col("path"), marked).alias("language"))


@query
def looks_like_sql(t):
    shape = F.col("doc_id") % 4
    text = (
        F.when(shape == 0, F.concat(F.lit(" ((\nSelect "), "text")).when(shape == 1, F.concat(F.lit("with "), "text"))
        .when(shape == 2, "SELECT 1").otherwise(F.col("text")))
    return t.documents.select("doc_id", X.looks_like_sql(text).alias("is_sql"))


@query
def repo_normalise(t):
    host = F.regexp_extract(F.trim("url"), "^https?://([^/]+)", 1)
    name = F.concat(F.lit("r"), "page_id")
    asked = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" https://github.com/"), host, F.lit("/"), name, F.lit(".git ")))
        .when(F.col("page_id") % 3 == 1, F.concat(host, F.lit("//"), name, F.lit("/"))).otherwise(host))
    return t.pages.select("page_id", SF.normalise_repo(asked).alias("repo"))


@query
def ref_normalise(t):
    branch = F.concat(F.lit("b"), "page_id")
    shape = F.col("page_id") % 4
    ref = F.when(shape == 0, F.concat(F.lit("refs/heads/"), branch)).when(shape == 1, branch).otherwise("")
    return t.pages.select("page_id", SF.normalise_ref(ref, F.when(shape == 3, "dev")).alias("ref"))


@query
def snippet_window(t):
    start = (F.col("doc_id") % 5 + 1).cast("int")
    return t.documents.select("doc_id", X.snippet(F.col("text"), start, start + (F.col("doc_id") % 3).cast("int")).alias("snippet"))


@query
def token_lines(t):
    docs = t.documents.select(F.col("doc_id").alias("file_id"), F.lit(0).alias("unit_no"), F.lit("sql").alias("dialect"),
                              F.lit(1).alias("start_line"), F.col("text").alias("sql"))
    # texts are dealt out, not their tokens
    docs = docs.repartition(t.partitions("documents", 4, 8), "file_id")
    return sqlfacts.sql_tokens(docs).groupBy(F.col("file_id").alias("doc_id")).agg(
        F.max("eline").cast("bigint").alias("n_lines"))


@query
def dedupe_unit(t):
    rows = t.document_lines.withColumn("start_line", F.expr("start_line div 3").cast("int"))
    return rank.dedupe_unit(rows).select("file_id", "rule_id", "start_line", "end_line")


@query
def cap_per_rule(t):
    return rank.cap_per_rule(t.document_lines).select("file_id", "rule_id", "start_line")


@query
def dedupe_file(t):
    rows = t.document_lines.withColumn("unit_no", F.col("start_line") % 4).withColumn(
        "start_line", F.expr("start_line div 5").cast("int"))
    return rank.dedupe_file(rows).select("file_id", "unit_no", "rule_id", "start_line")


# --- tables: review ---------------------------------------------------------------------------

@query
def review_requests(t):
    return N.review_requests(t.review_candidates)


@query
def review_parse(t):
    return N.parse_answers(t.review_answers).select("finding_id", "is_bad", "is_real", "title", "severity", "confidence")


@query
def review_normalise(t):
    return N.reviewed_findings(t.review_candidates, t.review_answers).select(
        "id", "title", "reasoning", "impact", "proposed_fix", "proposed_snippet", "severity", "confidence")


@query
def severity_normalise(t):
    text = F.concat(F.lit(" "), F.when(F.col("o_orderpriority") == "1-URGENT", "Critical").otherwise(
        F.substring("o_orderpriority", 3, 20)), F.lit("\t"))
    return t.orders.select("o_orderkey", N.severity(text).alias("severity"))


@query
def drop_false_positives(t):
    return N.reviewed_findings(t.review_candidates, t.review_answers).select("id")


@query
def review_fallback(t):
    """User turns as candidates, the following assistant turn as their answer: prose is no JSON object."""
    turn_id = F.concat("conv_id", F.lit("-"), "turn")
    user = t.conversations.where(F.col("role") == "user").select(
        turn_id.alias("id"), F.lit("job").alias("job_id"), F.lit("conv").alias("repo"), F.lit("main").alias("ref"),
        F.lit("c.py").alias("file_path"), F.lit("python").alias("language"), F.lit("py.time_sleep").alias("rule_id"),
        F.lit("time.sleep").alias("title"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.col("text").alias("snippet"), F.lit("hint").alias("hint"))
    answers = t.conversations.where(F.col("role") == "assistant").select(
        F.concat("conv_id", F.lit("-"), F.col("turn") - 1).alias("finding_id"), F.col("text").alias("raw"),
        F.lit(None).cast("string").alias("error"))
    return N.reviewed_findings(user, answers).select("id", "severity", "confidence", "impact", "proposed_snippet")


# --- tables: store, decisions, views ----------------------------------------------------------

@query
def json_roundtrip(t):
    return store.from_payload(store.to_payload(t.findings), S.FINDINGS)


@query
def export_json(t):
    rows = store.export_rows(t.jobs, t.findings)
    return rows.select("kind", "id", F.size(F.json_object_keys("payload")).alias("n_keys"),
                       F.get_json_object("payload", "$.repo").alias("repo"))


@query
def list_findings(t):
    return views.list_findings(t.findings, "job3", "approved", "repo_3").select("id", "title")


@query
def list_jobs(t):
    return views.list_jobs(t.jobs)


@query
def approved_findings(t):
    return state.approved_findings(t.findings, "repo_3").select("id", "job_id")


@query
def report_eligibility(t):
    requests = t.events.select((F.col("user_id") * 15).cast("string").alias("job_id"))
    return state.report_eligibility(requests, t.jobs)


@query
def status_counts(t):
    return views.status_counts(t.findings, ["repo"])


@query
def upsert_findings(t):
    base = t.findings.select("id", F.lit(0).cast("bigint").alias("seq"), "title")
    updates = t.events.select((F.col("user_id") * 200).cast("string").alias("id"), (F.col("event_id") + 1).alias("seq"),
                              F.col("event_type").alias("title"))
    return store.upsert(base, updates)


@query
def upsert_jobs(t):
    base = t.jobs.select("id", F.lit(0).cast("bigint").alias("seq"), "source")
    updates = t.events.select((F.col("user_id") * 15).cast("string").alias("id"), (F.col("event_id") + 1).alias("seq"),
                              F.col("event_type").alias("source"))
    return store.upsert(base, updates)


@query
def update_findings(t):
    updates = t.events.groupBy((F.col("user_id") * 200).cast("string").alias("id")).agg(
        F.max_by("event_type", "event_id").alias("title"))
    return state.update_findings(t.findings.select("id", "job_id", "repo", "title", "status"), updates)


@query
def apply_decisions(t):
    return state.apply_decisions(t.findings, t.decisions).select("id", "status", "reviewer_notes", "proposed_snippet")


@query
def decision_rejects(t):
    return state.decision_rejects(t.findings, t.decisions)


@query
def mark_applied(t):
    used = state.approved_findings(t.findings, "repo_3")
    return state.mark_applied(t.findings, used).select("id", "status")


@query
def apply_snippet_first(t):
    snippet = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.substring("text", 3, 6))
    rewrite = F.concat(F.lit("<"), "doc_id", F.lit(">"))
    return t.documents.select("doc_id", patch.replace_first(F.col("text"), snippet, rewrite).alias("content"))


@query
def apply_snippet_lines(t):
    start = (F.col("doc_id") % 4 + 1).cast("int")
    return t.documents.select("doc_id", patch.replace_lines(
        F.col("text"), start, start + (F.col("doc_id") % 2).cast("int"), F.lit("new\ntext")).alias("content"))


@query
def patch_report(t):
    return patch.report_lines(t.findings.where(F.col("status") == "approved"))


@query
def queue_view(t):
    return views.queue_view(t.findings).drop("language")


@query
def job_view(t):
    return views.job_view(t.jobs, t.findings)


@query
def status_view(t):
    return views.status_view(t.findings)
