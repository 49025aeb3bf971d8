"""DuckDB SQL for the queries: direct SQL on the tables, or expected rows per corpus template written by hand."""

from __future__ import annotations

from codesift import schemas as S
from codesift.corpus import TEMPLATES

# Expected hits per template: (template, rule, start line, end line).
EXPECTED = [
    (0, "sql.select_star", 1, 1), (0, "sql.leading_wildcard_like", 3, 3), (0, "sql.function_on_column", 4, 4),
    (0, "sql.order_without_limit", 5, 5),
    (1, "sql.distinct", 2, 2), (1, "sql.in_subquery", 4, 5), (1, "sql.not_in_subquery", 7, 7),
    (2, "sql.correlated_subquery", 4, 5),
    *[(3, "sql.select_star", line, line) for line in range(1, 10)],
    (4, "sql.select_star", 1, 1), (4, "sql.cross_join", 1, 1),
    (5, "py.pandas_iterrows", 5, 5), (5, "py.pandas_itertuples", 7, 7), (5, "py.pandas_apply", 9, 9),
    (6, "py.nested_same_iterable", 7, 8), (6, "py.string_concat_loop", 8, 8), (6, "py.time_sleep", 9, 9),
    (6, "py.time_sleep", 10, 10), (6, "py.read_all", 12, 12), (6, "py.read_all", 14, 14),
    (7, "spark.python_udf", 4, 4), (7, "spark.collect", 10, 10), (7, "spark.to_pandas", 11, 11),
    (7, "spark.count_in_loop", 13, 13), (7, "spark.coalesce_one", 15, 15), (7, "spark.cartesian", 15, 15),
    (7, "spark.repartition_no_key", 16, 16), (7, "spark.large_take", 19, 19), (7, "spark.rdd_action", 20, 20),
    (8, "spark.collect", 6, 6),
    (9, "sql.select_star", 3, 3), (9, "sql.order_without_limit", 4, 4),
    (10, "sql.distinct", 3, 3), (10, "sql.select_star", 7, 7),
    (15, "spark.collect", 8, 9),
    (16, "sql.select_star", 2, 2), (16, "sql.order_without_limit", 2, 2),
    *[(17, "sql.function_on_column", line, line) for line in range(1, 6)], (17, "sql.leading_wildcard_like", 6, 6),
    (18, "sql.select_star", 1, 1), (18, "sql.leading_wildcard_like", 3, 3),
    (20, "sql.function_on_column", 1, 1), (20, "sql.leading_wildcard_like", 2, 2), (21, "sql.correlated_subquery", 3, 3),
    (22, "sql.distinct", 1, 1), (22, "sql.leading_wildcard_like", 1, 1),
    (25, "py.pandas_iterrows", 1, 1), (25, "sql.select_star", 2, 2),
]
N = len(TEMPLATES)


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


SUFFIXES = "[" + ", ".join(lit(s) for s, _ in TEMPLATES) + "]"
FILES = f"""f AS (
  SELECT o_orderkey AS k, o_orderkey % {N} AS tid, 'repo_' || (o_custkey % 10) AS repo, 'main' AS ref,
         CASE WHEN o_orderkey % {N} = 11 THEN 'node_modules/f' || o_orderkey || '.py'
              ELSE 'src/m' || (o_orderkey % 100) || '/f' || o_orderkey || ({SUFFIXES})[(o_orderkey % {N} + 1)::INT] END AS path
  FROM orders)"""
TEXTS = "texts(tid, template) AS (VALUES " + values([(i, t) for i, (_, t) in enumerate(TEMPLATES)]) + ")"
CONTENTS = f"{FILES}, {TEXTS}, c AS (SELECT f.*, replace(template, '@K@', k::VARCHAR) AS content FROM f JOIN texts USING (tid))"


def by_template(columns: str, rows: list[tuple], select: str) -> str:
    """Rows expected for a template, repeated for every file made from it."""
    return f"WITH {FILES}, e({columns}) AS (VALUES {values(rows)}) SELECT {select} FROM f JOIN e ON f.tid = e.tid"


def rule_hits(rule: str) -> str:
    return by_template("tid, s, e", [(t, s, e) for t, r, s, e in EXPECTED if r == rule],
                       "repo, path AS file_path, s AS start_line, e AS end_line")


FINDINGS = """findings AS (
  SELECT o_orderkey::VARCHAR AS id, 'job' || (o_custkey % 20) AS job_id, 'repo_' || (o_custkey % 10) AS repo,
         'main' AS ref, 'src/m' || (o_orderkey % 100) || '.py' AS file_path, 'spark' AS language,
         'spark.collect' AS rule_id, 'Finding ' || (o_orderkey % 25) AS title,
         (o_orderkey % 50 + 1)::INT AS start_line, (o_orderkey % 50 + 2)::INT AS end_line, 'x.collect()' AS snippet,
         repeat('word ', o_orderkey % 60) AS reasoning, 'driver' AS impact, 'use limit' AS proposed_fix,
         'x.limit(10)' AS proposed_snippet,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
              WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity,
         (o_orderkey % 101)::DOUBLE / 100.0::DOUBLE AS confidence,
         CASE WHEN o_orderkey % 13 = 0 THEN 'applied' WHEN o_orderstatus = 'O' THEN 'pending'
              WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS status,
         '' AS reviewer_notes, strftime(o_orderdate, '%Y-%m-%d') AS created_at
  FROM orders)"""
JOBS = """jobs AS (
  SELECT c_custkey::VARCHAR AS id, c_name AS repo, 'main' AS ref,
         CASE WHEN c_nationkey % 2 = 0 THEN 'github' ELSE 'local' END AS source, '2024-01-01' AS created_at,
         (c_custkey % 5)::INT AS files_scanned, (c_custkey % 9)::INT AS candidates_found,
         (c_custkey % 7)::INT AS findings_count
  FROM customer)"""
DECISIONS = """decisions AS (
  SELECT (user_id * 200)::VARCHAR AS finding_id, event_id AS seq,
         CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE event_type END AS action,
         props AS notes,
         CASE WHEN event_id % 3 = 0 THEN ' ' ELSE floor(value * 100)::BIGINT::VARCHAR END AS proposed_snippet
  FROM events)"""
FOLDED = """folded AS (
  SELECT finding_id AS id, CASE WHEN arg_max(action, seq) = 'approve' THEN 'approved' ELSE 'rejected' END AS status,
         arg_max(notes, seq) AS notes,
         arg_max(proposed_snippet, seq) FILTER (WHERE trim(proposed_snippet) <> '') AS proposed_snippet
  FROM decisions WHERE action IN ('approve', 'reject') GROUP BY finding_id)"""
TREE = """tree AS (
  SELECT lang AS repo, 'main' AS ref, doc_id AS pos, 's' || doc_id AS sha,
         source || '/' || (['src','node_modules','dist','lib','.venv','build.d'])[(doc_id % 6 + 1)::INT] || '/' || doc_id
           || (['.sql','.py','.scala','.PY','.txt'])[(doc_id % 5 + 1)::INT] AS path,
         CASE WHEN doc_id % 7 = 0 THEN 'tree' ELSE 'blob' END AS type,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS size
  FROM documents)"""
SKIPPED = "(list_has_any(string_split(path, '/'), [" + ", ".join(lit(p) for p in S.SKIP_PARTS) + "]))"
SUPPORTED = f"(NOT {SKIPPED} AND lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.sql', '.py', '.scala'))"
LISTED = f"listed AS (SELECT * FROM tree WHERE type = 'blob' AND {SUPPORTED} AND coalesce(size, 0) <= 2000)"
CAPPED = "capped AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY repo, ref ORDER BY pos) AS nth FROM listed) WHERE nth <= 20)"
CANDIDATES = """cands AS (
  SELECT doc_id, doc_id::VARCHAR AS id, lang AS repo, source || '.py' AS file_path, (doc_id % 9 + 1)::INT AS line,
         text AS snippet, 'hint ' || source AS hint FROM documents)"""
LINES = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents)"""
TEXT_LINES = """dl AS (
  SELECT doc_id, text, CASE WHEN text = '' OR text[-1] = chr(10) THEN string_split(text, chr(10))[:-2]
                            ELSE string_split(text, chr(10)) END AS ls FROM documents)"""
ANSWERED = """a AS (
  SELECT doc_id, quality, doc_id % 6 AS shape, doc_id % 17 = 0 AS failed FROM labels)"""
REVIEW_FLAGS = """flags AS (
  SELECT *, failed OR shape = 2 AS is_bad,
         CASE shape WHEN 1 THEN quality <> 0 WHEN 5 THEN false WHEN 2 THEN true ELSE true END AS is_real FROM a)"""
REVIEWED = f"""{CANDIDATES}, {ANSWERED}, {REVIEW_FLAGS}, reviewed AS (
  SELECT c.*, coalesce(is_bad, true) AS bad, shape FROM cands c LEFT JOIN flags USING (doc_id)
  WHERE coalesce(is_bad, true) OR is_real)"""

ORACLES: dict[str, str] = {}
for _t, _rule, _s, _e in EXPECTED:
    ORACLES.setdefault("rule_" + _rule.split(".")[1], rule_hits(_rule))
ORACLES = {k.replace("rule_pandas_iter", "rule_iter"): v for k, v in ORACLES.items()}

ORACLES |= {
    # --- tokens and facts on the corpus
    "py_string_literals": by_template("tid, line, t", [
        (5, 9, "a"), (5, 11, "a"), (6, 5, ""), (7, 4, "string"), (7, 9, "o@K@"), (7, 17, "k"), (8, 7, "x.collect()"),
        (9, 2, "\n      SELECT r.*\n      FROM ramp@K@ r ORDER BY r.seen\n    "),
        (16, 2, " SELECT * FROM t@K@ ORDER BY x"), (15, 4, "p"), (15, 5, "a > 1"), (15, 8, "a"),
        (25, 2, " SELECT * FROM some_table_@K@"),
    ], "path AS file_path, line AS start_line, replace(t, '@K@', k::VARCHAR) AS text"),
    "scala_string_literals": by_template("tid, line, t", [
        (10, 2, "\n    SELECT DISTINCT a.id\n    FROM t@K@ a\n    "), (10, 6, "short"),
        (10, 7, "SELECT * FROM table_@K@ x"),
    ], "path AS file_path, line AS start_line, replace(t, '@K@', k::VARCHAR) AS text"),
    "sql_units": by_template("tid, line, dialect, t", [
        *[(i, 1, "sql", TEMPLATES[i][1]) for i in range(5)],
        (9, 2, "sql", "\n      SELECT r.*\n      FROM ramp@K@ r ORDER BY r.seen\n    "),
        (16, 2, "sql", " SELECT * FROM t@K@ ORDER BY x"), *[(i, 1, "sql", TEMPLATES[i][1]) for i in (17, 18, 20, 21, 22)],
        (25, 2, "sql", " SELECT * FROM some_table_@K@"),
        (10, 2, "spark", "\n    SELECT DISTINCT a.id\n    FROM t@K@ a\n    "),
        (10, 7, "spark", "SELECT * FROM table_@K@ x"),
    ], "path AS file_path, line AS start_line, dialect, replace(t, '@K@', k::VARCHAR) AS sql"),
    "sql_statements": by_template("tid, line, n", [
        (0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 9), (4, 1, 1), (9, 2, 1), (10, 2, 1), (10, 7, 1),
        (16, 2, 1), (17, 1, 7), (18, 1, 1),
        (20, 1, 2), (21, 1, 1), (22, 1, 1), (25, 2, 1),
    ], "path AS file_path, line AS start_line, n::BIGINT AS n_statements"),
    "comment_mask": by_template("tid, w, n", [
        (0, "SELECT", 1), (1, "SELECT", 3), (2, "SELECT", 2), (3, "SELECT", 9), (4, "SELECT", 2), (9, "SELECT", 1),
        (10, "SELECT", 2), (7, "collect", 1), (7, "toPandas", 1), (8, "collect", 3), (15, "collect", 1),
        (16, "SELECT", 1), (17, "SELECT", 7), (18, "SELECT", 1),
        (20, "SELECT", 2), (21, "SELECT", 2), (22, "SELECT", 1), (25, "SELECT", 1),
    ], "path AS file_path, w AS word, n::BIGINT AS n"),
    "sql_clause_context": by_template("tid, line, op, c", [
        (0, 3, "LIKE", True), (0, 4, "<", True), (1, 8, "=", True), (17, 1, "=", True), (17, 2, "=", True), (17, 3, "LIKE", True),
        (17, 4, ">", True), (17, 4, "=", True), (17, 5, "=", True), (17, 6, "LIKE", True), (17, 7, "=", True),
        (17, 7, "=", True), (18, 3, "=", True), (18, 3, "LIKE", True), (2, 5, "=", True), (2, 8, ">", True),
        (20, 1, "=", True), (20, 1, "=", True), (20, 2, "LIKE", True), (21, 3, "=", True), (22, 1, "=", True), (22, 1, "LIKE", True),
    ], "path AS file_path, line, op, c AS in_filter"),
    "py_imports": by_template("tid, l, m", [
        (5, "pd", "pandas"), (6, "time", "time"), (6, "nap", "time.sleep"), (7, "F", "pyspark.sql.functions"),
        (7, "udf", "pyspark.sql.functions.udf"), (8, "gc", "gc"), (14, "pd", "pandas"),
        (15, "SparkSession", "pyspark.sql.SparkSession"),
    ], "path AS file_path, l AS name, m AS module"),
    "py_bindings": by_template("tid, line, n, tag", [
        (5, 4, "df", "pandas"), (5, 9, "s", "pandas"), (6, 5, "out", "string"),
        *[(7, line, name, "spark") for line, name in zip((9, 10, 11, 13, 15, 16, 17, 18, 19, 20, 21, 22), "orpnxyzabcde")],
        (8, 6, "rows", "spark"), (8, 7, "txt", "string"),
        (9, 2, "query", "string"),
        (15, 2, "spark", "spark"), (15, 3, "df", "spark"), (15, 7, "rows", "spark"), (25, 2, "q", "string"),
    ], "path AS file_path, line, n AS name, tag"),
    "py_scopes": by_template("tid, line", [
        *[(5, i) for i in range(4, 13)], *[(6, i) for i in range(5, 15)], (7, 6), *[(7, i) for i in range(9, 23)],
        (8, 4), (8, 5), (8, 6), (8, 7), (8, 9), (9, 2), (9, 6), *[(14, i) for i in range(4, 9)], (16, 2),
    ], "path AS file_path, line, 1 AS n_defs"),
    "py_loop_depth": by_template("tid, line, d", [
        (5, 5, 1), (5, 6, 1), (5, 7, 1), (5, 8, 1), (6, 6, 1), (6, 7, 2), (6, 8, 2), (7, 12, 1), (7, 13, 1), (7, 14, 1),
        (14, 5, 1), (14, 6, 2), (14, 7, 2),
    ], "path AS file_path, line, d AS loop_depth"),
    "py_file_handles": by_template("tid, line", [(6, 12), (6, 13)], "path AS file_path, line, 'fh' AS name"),
    "py_chain_roots": by_template("tid, line, m, r", [
        (5, 5, "iterrows", "df"), (5, 7, "itertuples", "df"), (5, 9, "apply", "df"), (5, 11, "apply", "df"),
        (6, 9, "sleep", "time"), (6, 12, "read", "fh"), (6, 13, "read", "fh"), (6, 14, "read_text", "path"),
        (7, 10, "collect", "o"), (7, 11, "toPandas", "o"), (7, 13, "count", "o"), (7, 15, "crossJoin", "o"),
        (7, 15, "coalesce", "o"), (7, 16, "repartition", "o"), (7, 17, "repartition", "o"), (7, 18, "take", "o"),
        (7, 19, "take", "o"), (7, 20, "map", "o"), (7, 21, "map", "o"), (8, 4, "collect", "gc"), (8, 5, "collect", "q"),
        (8, 6, "collect", "spark"), (14, 4, "apply", "seen"), (15, 8, "collect", "df"),
        (25, 1, "iterrows", "df"),
    ], "path AS file_path, line, m AS method, r AS root"),
    "py_calls": by_template("tid, line, m, a", [
        (6, 9, "sleep", 1), (6, 13, "read", 10), (7, 15, "coalesce", 1), (7, 16, "repartition", 8), (7, 18, "take", 999), (7, 19, "take", 1000),
    ], "path AS file_path, line, m AS method, a::BIGINT AS int_arg"),
    "lex_status": by_template("tid, n", [(13, 1)], "path AS file_path, 0 AS unit_no, n::BIGINT AS open_brackets, false AS bad_quote"),
    # --- candidates, findings, summaries on the corpus
    "candidates_all": by_template("tid, r, s, e", EXPECTED, "repo, path AS file_path, r AS rule_id, s AS start_line, e AS end_line"),
    "candidates_on_text": """WITH t AS (
          SELECT doc_id, source, doc_id % 4 AS shape, length(text) - length(replace(text, chr(10), '')) AS breaks
          FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents))
        SELECT source AS repo, 'd' || doc_id || CASE WHEN shape IN (0, 2) THEN '.py' ELSE '.sql' END AS file_path,
          (['py.pandas_iterrows', 'sql.select_star', 'spark.to_pandas', 'sql.distinct'])[(shape + 1)::INT] AS rule_id,
          (breaks + CASE WHEN shape = 0 THEN 3 ELSE 2 END)::INT AS start_line, (breaks + CASE WHEN shape = 0 THEN 3 ELSE 2 END)::INT AS end_line
        FROM t""",
    "candidates_enriched": f"""WITH {CONTENTS}, e(tid, rule_id, s, e) AS (VALUES {values(EXPECTED)}),
        r(rule_id, title, hint, language) AS (VALUES {values([(a, t, h, S.RULE_LANGUAGE[a.split('.')[0]]) for a, t, h in S.RULES])})
        SELECT repo, ref, path AS file_path, language, rule_id, title, s AS start_line, e AS end_line, hint,
          array_to_string(string_split(rtrim(content, chr(10)), chr(10))[greatest(s - 3, 1):e + 3], chr(10)) AS snippet
        FROM c JOIN e USING (tid) JOIN r USING (rule_id)""",
    "default_findings": f"""WITH {FILES}, e(tid, rule_id, s, e) AS (VALUES {values(EXPECTED)}),
        r(rule_id, title, hint, language) AS (VALUES {values([(a, t, h, S.RULE_LANGUAGE[a.split('.')[0]]) for a, t, h in S.RULES])})
        SELECT sha256('job1' || chr(1) || path || chr(1) || rule_id || chr(1) || s) AS id, 'job1' AS job_id, repo,
          path AS file_path, rule_id, title, s AS start_line, hint AS reasoning, {lit(S.DEFAULT_IMPACT)} AS impact,
          {lit(S.DEFAULT_FIX)} AS proposed_fix, 'medium' AS severity, 0.55::DOUBLE AS confidence, 'pending' AS status
        FROM f JOIN e USING (tid) JOIN r USING (rule_id)""",
    "job_summary": f"""WITH {FILES}, e(tid, n) AS (SELECT tid, count(*) FROM (VALUES {values(EXPECTED)}) v(tid, r, s, e) GROUP BY tid)
        SELECT repo, ref, count(*)::INT AS files_scanned, sum(coalesce(n, 0))::INT AS candidates_found,
          sum(coalesce(n, 0))::INT AS findings_count
        FROM f LEFT JOIN e USING (tid) WHERE tid NOT IN (11, 12) GROUP BY repo, ref""",
    "job_rows": f"""WITH {REVIEWED}, n AS (SELECT repo, count(*)::INT AS n FROM reviewed GROUP BY repo)
        SELECT 'job-' || lang AS id, lang AS repo, 'main' AS ref, 'local' AS source, '2024-01-01' AS created_at,
          count(*)::INT AS files_scanned, count(*)::INT AS candidates_found, coalesce(any_value(n), 0) AS findings_count
        FROM documents LEFT JOIN n ON repo = lang GROUP BY lang""",
    "scan_report": f"""WITH {FILES}, e(tid, n) AS (SELECT tid, count(*) FROM (VALUES {values(EXPECTED)}) v(tid, r, s, e) GROUP BY tid)
        SELECT repo, path, row_number() OVER (PARTITION BY repo, ref ORDER BY string_split(path, '/')) AS position,
          count(*) OVER (PARTITION BY repo, ref) AS total,
          CASE WHEN tid IN (9, 16, 25) THEN 'tokens+sql' ELSE 'tokens' END AS engine, coalesce(n, 0)::INT AS n_candidates,
          CASE tid WHEN 13 THEN 'unreadable: line 1: bracket was never closed' WHEN 19 THEN 'unreadable: line 1: invalid syntax'
            WHEN 23 THEN 'unreadable: line 3: unindent does not match any outer level'
            WHEN 24 THEN 'unreadable: line 2: invalid syntax' ELSE CASE WHEN n IS NULL THEN 'no issues' ELSE '' END END AS detail
        FROM f LEFT JOIN e USING (tid) WHERE tid NOT IN (11, 12)""",
    "scan_summary": f"""WITH {FILES}, e(tid, rule_id, s, e) AS (VALUES {values(EXPECTED)}),
        r(rule_id, title) AS (VALUES {values([(a, t) for a, t, _ in S.RULES])})
        SELECT repo, 'medium' AS severity, path || ':' || s AS place, title FROM f JOIN e USING (tid) JOIN r USING (rule_id)""",
    "patched_files": f"""WITH {CONTENTS}, l AS (
          SELECT *, k % 4 AS kind, string_split(rtrim(content, chr(10)), chr(10)) AS ls FROM c)
        SELECT repo, path, CASE WHEN kind = 2
            THEN array_to_string(list_concat(['L1'], ls[least(3, len(ls)) + 2:]), chr(10)) || chr(10)
          WHEN kind = 3 THEN array_to_string(list_transform(ls, lambda x, i: CASE WHEN i <= 40 THEN 'L' || i ELSE x END), chr(10)) || chr(10)
          WHEN contains(content, 'SELECT *')
            THEN substr(content, 1, instr(content, 'SELECT *') - 1) || 'SELECT id' || substr(content, instr(content, 'SELECT *') + 8)
            ELSE 'PATCH' || chr(10) || array_to_string(ls[2:], chr(10)) || CASE WHEN len(ls) > 1 THEN chr(10) ELSE '' END END AS content,
          (CASE kind WHEN 1 THEN 1 WHEN 2 THEN least(3, len(ls)) ELSE least(40, len(ls)) END)::INT AS n_applied,
          kind = 2 AND len(ls) > 1 AS overlap
        FROM l WHERE kind > 0""",
    "findings_store": f"""WITH {FINDINGS}
        SELECT id, job_id, repo, title, CASE WHEN again THEN 'applied' ELSE status END AS status,
          CASE WHEN again THEN 'by ' || id ELSE reviewer_notes END AS reviewer_notes, confidence
        FROM (SELECT *, id::BIGINT % 3 = 0 AND job_id < 'job15' AS again FROM findings)""",
    # --- sources and filters on the tables
    "filter_skip_dirs": f"WITH {TREE} SELECT path FROM tree WHERE NOT {SKIPPED}",
    "filter_suffix": f"WITH {TREE} SELECT path FROM tree WHERE {SUPPORTED}",
    "tree_filter": f"WITH {TREE}, {LISTED} SELECT repo, path, size FROM listed",
    "tree_cap": f"WITH {TREE}, {LISTED}, {CAPPED} SELECT repo, path, pos FROM capped",
    "src_snapshot_join": f"""WITH {TREE}
        SELECT repo, path, sha, text AS content FROM tree JOIN documents ON doc_id = pos
        WHERE type = 'blob' AND {SUPPORTED} AND pos % 13 <> 0""",
    "src_union": """SELECT 'github' AS source, lang AS repo, doc_id::VARCHAR AS path FROM documents
        UNION ALL SELECT 'local', 'local/pages', page_id::VARCHAR FROM pages""",
    "classify_language": f"""WITH {TREE} SELECT path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1))
          WHEN '.sql' THEN 'sql' WHEN '.scala' THEN 'spark'
          WHEN '.py' THEN CASE WHEN doc_id % 2 = 0 OR contains(lower(text), 'pyspark') THEN 'spark' ELSE 'python' END END AS language
        FROM tree JOIN documents ON doc_id = pos""",
    "looks_like_sql": """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ((' || chr(10) || 'Select ' || text
            WHEN 1 THEN 'with ' || text WHEN 2 THEN 'SELECT 1' ELSE text END AS s FROM documents),
          b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '^\\(+', ''), '^\\s+|\\s+$', '', 'g') AS s FROM t)
        SELECT doc_id, length(s) >= 20 AND lower(regexp_extract(s, '^(\\S+)', 1)) IN ('select','with','insert','update','delete','merge') AS is_sql FROM b""",
    "repo_normalise": """SELECT page_id, CASE page_id % 3 WHEN 2 THEN NULL
          ELSE regexp_extract(trim(url), '^https?://([^/]+)', 1) || '/r' || page_id END AS repo FROM pages""",
    "ref_normalise": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'b' || page_id WHEN 1 THEN 'b' || page_id
          WHEN 2 THEN 'main' ELSE 'dev' END AS ref FROM pages""",
    "snippet_window": f"""WITH {TEXT_LINES} SELECT doc_id,
          array_to_string(ls[greatest((doc_id % 5 + 1) - 3, 1):least(len(ls), doc_id % 5 + 1 + doc_id % 3 + 3)], chr(10)) AS snippet FROM dl""",
    "token_lines": "SELECT doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS n_lines FROM documents",
    "dedupe_unit": f"""WITH {LINES} SELECT doc_id AS file_id, regexp_extract(t, '^(\\S*)', 1) AS rule_id, (line // 3)::INT AS start_line, max(line)::INT AS end_line
        FROM lines GROUP BY ALL""",
    "cap_per_rule": f"""WITH {LINES}, r AS (SELECT doc_id AS file_id, regexp_extract(t, '^(\\S*)', 1) AS rule_id, line::INT AS start_line FROM lines)
        SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY file_id, rule_id ORDER BY start_line) AS nth FROM r) WHERE nth <= 8""",
    "dedupe_file": f"""WITH {LINES}, r AS (SELECT doc_id AS file_id, (line % 4)::INT AS unit_no, regexp_extract(t, '^(\\S*)', 1) AS rule_id, (line // 5)::INT AS start_line, line FROM lines)
        SELECT file_id, unit_no, rule_id, start_line FROM (SELECT *, row_number() OVER (PARTITION BY file_id, rule_id, start_line ORDER BY unit_no, line) AS nth FROM r) WHERE nth = 1""",
    # --- review
    "review_requests": f"""WITH {CANDIDATES} SELECT id, 'Repository: ' || repo || '@main' || chr(10) || 'File: ' || file_path || chr(10)
          || 'Language: python' || chr(10) || 'Heuristic: py.time_sleep (time.sleep)' || chr(10) || 'Hint: ' || hint || chr(10)
          || 'Lines: ' || line || '-' || line || chr(10) || chr(10) || 'Snippet:' || chr(10) || '```' || chr(10) || snippet
          || chr(10) || '```' || chr(10) AS request FROM cands""",
    "review_parse": f"""WITH {ANSWERED}, {REVIEW_FLAGS} SELECT doc_id::VARCHAR AS finding_id, is_bad, is_real,
          CASE WHEN shape = 0 THEN 'Real ' || doc_id END AS title,
          CASE shape WHEN 0 THEN ' HIGH ' WHEN 1 THEN 'bogus' END AS severity,
          CASE shape WHEN 0 THEN '0.9' END AS confidence FROM flags""",
    "review_normalise": f"""WITH {REVIEWED} SELECT id, CASE WHEN NOT bad AND shape = 0 THEN 'Real ' || id ELSE 'time.sleep' END AS title,
          hint AS reasoning,
          CASE WHEN bad THEN {lit(S.DEFAULT_IMPACT)} WHEN shape = 4 THEN 'cost' ELSE 'Performance' END AS impact,
          CASE WHEN bad THEN {lit(S.DEFAULT_FIX)} WHEN shape = 4 THEN 'rewrite' ELSE '' END AS proposed_fix,
          CASE WHEN NOT bad AND shape = 4 THEN 'x' ELSE snippet END AS proposed_snippet,
          CASE WHEN NOT bad AND shape = 0 THEN 'high' ELSE 'medium' END AS severity,
          (CASE WHEN bad THEN 0.55 WHEN shape = 0 THEN 0.9 ELSE 0.5 END)::DOUBLE AS confidence FROM reviewed""",
    "severity_normalise": """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
          WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS severity FROM orders""",
    "drop_false_positives": f"WITH {REVIEWED} SELECT id FROM reviewed",
    "review_fallback": f"""SELECT u.conv_id || '-' || u.turn AS id, 'medium' AS severity, 0.55::DOUBLE AS confidence,
          {lit(S.DEFAULT_IMPACT)} AS impact, u.text AS proposed_snippet FROM conversations u WHERE u.role = 'user'""",
    # --- store, decisions, views
    "json_roundtrip": f"WITH {FINDINGS} SELECT * FROM findings",
    "export_json": f"WITH {FINDINGS}, {JOBS} SELECT 'finding' AS kind, id, 20::INT AS n_keys, repo FROM findings UNION ALL SELECT 'job', id, 8::INT, repo FROM jobs",
    "list_findings": f"WITH {FINDINGS} SELECT id, title FROM findings WHERE job_id = 'job3' AND status = 'approved' AND repo = 'repo_3' ORDER BY id",
    "list_jobs": f"WITH {JOBS} SELECT * FROM jobs ORDER BY id DESC",
    "approved_findings": f"WITH {FINDINGS} SELECT id, job_id FROM findings WHERE status = 'approved' AND repo = 'repo_3'",
    "report_eligibility": f"""WITH {JOBS} SELECT (user_id * 15)::VARCHAR AS job_id, CASE WHEN id IS NULL THEN 'job not found'
          WHEN source <> 'github' THEN 'local scan' END AS reason FROM events LEFT JOIN jobs ON id = (user_id * 15)::VARCHAR""",
    "status_counts": f"""WITH {FINDINGS} SELECT repo, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved,
          count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'applied') AS applied FROM findings GROUP BY repo""",
    "upsert_findings": f"""WITH {FINDINGS}, u AS (SELECT (user_id * 200)::VARCHAR AS id, event_id + 1 AS seq, event_type AS title FROM events),
          w AS (SELECT id, 0::BIGINT AS seq, title FROM findings UNION ALL SELECT id, seq, title FROM u)
        SELECT id, max(seq) AS seq, arg_max(title, seq) AS title FROM w GROUP BY id""",
    "upsert_jobs": f"""WITH {JOBS}, u AS (SELECT (user_id * 15)::VARCHAR AS id, event_id + 1 AS seq, event_type AS source FROM events),
          w AS (SELECT id, 0::BIGINT AS seq, source FROM jobs UNION ALL SELECT id, seq, source FROM u)
        SELECT id, max(seq) AS seq, arg_max(source, seq) AS source FROM w GROUP BY id""",
    "update_findings": f"""WITH {FINDINGS}, u AS (SELECT (user_id * 200)::VARCHAR AS id, arg_max(event_type, event_id) AS title FROM events GROUP BY 1)
        SELECT f.id, f.job_id, f.repo, coalesce(u.title, f.title) AS title, f.status FROM findings f LEFT JOIN u USING (id)""",
    "apply_decisions": f"""WITH {FINDINGS}, {DECISIONS}, {FOLDED} SELECT f.id, coalesce(d.status, f.status) AS status,
          coalesce(d.notes, f.reviewer_notes) AS reviewer_notes, coalesce(d.proposed_snippet, f.proposed_snippet) AS proposed_snippet
        FROM findings f LEFT JOIN folded d USING (id)""",
    "decision_rejects": f"""WITH {FINDINGS}, {DECISIONS} SELECT finding_id, seq, action,
          CASE WHEN f.id IS NULL THEN 'unknown finding' ELSE 'unknown action' END AS reason
        FROM decisions LEFT JOIN findings f ON f.id = finding_id WHERE f.id IS NULL OR action NOT IN ('approve', 'reject')""",
    "mark_applied": f"WITH {FINDINGS} SELECT id, CASE WHEN status = 'approved' AND repo = 'repo_3' THEN 'applied' ELSE status END AS status FROM findings",
    "apply_snippet_first": """WITH t AS (SELECT doc_id, text, CASE doc_id % 2 WHEN 0 THEN '' ELSE substr(text, 3, 6) END AS s FROM documents)
        SELECT doc_id, substr(text, 1, instr(text, s) - 1) || '<' || doc_id || '>' || substr(text, instr(text, s) + length(s)) AS content
        FROM t WHERE s <> '' UNION ALL SELECT doc_id, '<' || doc_id || '>' || text FROM t WHERE s = ''""",
    "apply_snippet_lines": f"""WITH {TEXT_LINES}, p AS (SELECT *, doc_id % 4 + 1 AS s, least(doc_id % 4 + 1 + doc_id % 2, len(ls)) AS e FROM dl)
        SELECT doc_id, array_to_string(ls[:s - 1] || ['new', 'text'] || ls[e + 1:], chr(10))
          || CASE WHEN text[-1] = chr(10) THEN chr(10) ELSE '' END AS content FROM p""",
    "queue_view": f"""WITH {FINDINGS} SELECT id, severity, status, file_path || ':' || start_line AS place, repo, title,
          CASE WHEN length(reasoning) > 180 THEN left(reasoning, 180) || '…' ELSE reasoning END AS reasoning FROM findings""",
    "job_view": f"""WITH {FINDINGS}, {JOBS} SELECT id, repo, findings_count,
          source = 'github' AND (SELECT count(*) FROM findings WHERE status = 'approved') > 0 AS can_patch FROM jobs""",
    "status_view": f"WITH {FINDINGS} SELECT left(id, 8) AS id, status, severity, repo, title FROM findings",
}


def _report() -> str:
    from codesift.operators.patch import REPORT_END, REPORT_INTRO, REPORT_MIDDLE

    fixed = [(p, i, t) for p, texts in ((1, REPORT_INTRO), (3, REPORT_MIDDLE), (5, REPORT_END)) for i, t in enumerate(texts)]
    section = [
        "'### ' || title || ' (`' || file_path || '`)'", "''",
        "'- Severity: `' || severity || '` (confidence ' || printf('%.2f', confidence) || ')'",
        "'- Impact: ' || impact", "'- Why: ' || reasoning", "'- Fix: ' || proposed_fix", "''",
    ]
    parts = [
        f"SELECT repo, job_id, part, '' AS id, line, text FROM (SELECT DISTINCT repo, job_id FROM ok), (VALUES {values(fixed)}) v(part, line, text)",
        "SELECT repo, job_id, 2, id, 0, '| ' || severity || ' | `' || file_path || ':' || start_line || '` | ' || title || ' |' FROM ok",
        *[f"SELECT repo, job_id, 4, id, {i}, {text} FROM ok" for i, text in enumerate(section)],
    ]
    return f"WITH {FINDINGS}, ok AS (SELECT * FROM findings WHERE status = 'approved') " + " UNION ALL ".join(parts)


ORACLES["patch_report"] = _report()
