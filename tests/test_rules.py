"""Rules on small files: each file with the (rule, start line) pairs it must give, all scanned in one plan."""

import ast
import time

import pytest
from pyspark.sql import functions as F

from codesift.operators import rules_py
from codesift.plans import audit

CASES = {
    # --- several rules in one file
    "stock.sql": ("""SELECT w.*
FROM warehouse w, LATERAL (
    SELECT DISTINCT s.sku FROM shelf s WHERE s.wid = w.id ORDER BY s.sku
) x
WHERE w.zone NOT IN (SELECT z.zone FROM closed z)
   OR TRIM(w.label) LIKE '%cold'
""", {("sql.select_star", 1), ("sql.distinct", 3), ("sql.order_without_limit", 3), ("sql.not_in_subquery", 5),
      ("sql.function_on_column", 6), ("sql.leading_wildcard_like", 6)}),
    "meter.py": ('''import pandas as pd
import time as clock


def read_meters(folder, names):
    log = ""
    table = pd.concat([pd.read_csv(folder / n) for n in names])
    for stamp, values in table.iterrows():
        log += f"{stamp};"
        for other in table.itertuples():
            clock.sleep(0.1)
    table["w"] = table["v"].apply(abs)
    return log + (folder / "notes").read_text()
''', {("py.pandas_iterrows", 8), ("py.string_concat_loop", 9), ("py.pandas_itertuples", 10), ("py.time_sleep", 11),
      ("py.pandas_apply", 12), ("py.read_all", 13)}),
    "lake.py": ('''from pyspark.sql import SparkSession, functions as sf

session = SparkSession.builder.getOrCreate()
sales = session.read.parquet("sales")
clean = sf.trim("name")
for day in range(31):
    if sales.where(f"d = {day}").count():
        sales.repartition(40).coalesce(1).write.save(str(day))
pairs = sales.crossJoin(sales)
frame = pairs.toPandas()
head = pairs.take(5000) + pairs.rdd.flatMap(list).collect()
''', {("spark.count_in_loop", 7), ("spark.repartition_no_key", 8), ("spark.coalesce_one", 8),
      ("spark.cartesian", 9), ("spark.to_pandas", 10), ("spark.large_take", 11), ("spark.rdd_action", 11), ("spark.collect", 11)}),
    # --- Python negatives and edges
    "empty.py": ("", set()),
    "no_newline.py": ("import time\ntime.sleep(1)", {("py.time_sleep", 2)}),
    "crlf.py": ("import time\r\n\r\ntime.sleep(1)\r\n", {("py.time_sleep", 3)}),
    "own_apply.py": ("def total(rule, rows):\n    for row in rows:\n        rule.apply(row)\n        for cell in row.cells:\n"
                     "            rule.apply(cell)\n", set()),
    "two_signs.py": ("x = = 1\ndf.iterrows()\n", set()),
    "no_colon.py": ("def f()\n    return 1\ndf.iterrows()\n", set()),
    "signs.py": ("x = -1 + -2 * +3\ny = x if x else -x\nz = lambda: x\nif x: y\nelse: z\nf = {1: 2}[1]\ndf.iterrows()\n",
                 {("py.pandas_iterrows", 7)}),
    "strings.py": ("x = 'df.iterrows()'\n# df.iterrows()\ny = \"\"\"\ndf.iterrows()\n\"\"\"\nz = f'{df.iterrows()}'\n",
                   {("py.pandas_iterrows", 6)}),
    "print2.py": ("print \"old\"\ndf.iterrows()\n", set()),
    "broken.py": ("def f(:\n    df.iterrows()\n", set()),
    "quote.py": ("x = 'abc\ndf.iterrows()\n", set()),
    "rebound.py": ("import pandas as pd\ndf = pd.read_csv('a')\ndf = df.dropna()\ndf.apply(len)\n"
                   "dg = pd.read_csv('a')\ndh = dg.dropna()\ndh.apply(len)\n", {("py.pandas_apply", 7)}),
    "scope.py": ("import pandas as pd\n\ndef f():\n    a = pd.DataFrame()\n    a.apply(len)\n\ndef g(a):\n    a.apply(len)\n"
                 "b = pd.DataFrame()\ndef h():\n    b.apply(len)\n    def i():\n        b.apply(len)\n    b = 1\n    b.apply(len)\n"
                 "b.apply(len)\n",
                 {("py.pandas_apply", 5), ("py.pandas_apply", 11), ("py.pandas_apply", 13), ("py.pandas_apply", 16)}),
    "parens.py": ("import pandas as pd\nx = ((pd.read_csv('a')\n  .dropna()))\nx.apply(len)\n(x.head()).apply(len)\n"
                  "(x + 1).apply(len)\ny = (x if x else None)\ny.apply(len)\n",
                  {("py.pandas_apply", 4), ("py.pandas_apply", 5)}),
    "take.py": ("def f(spark):\n    d = spark.table('a')\n    d.take(999)\n    d.take(1000)\n    d.take(1_000,)\n    d.take(-1000)\n"
                "    d.take(n=1000)\n    d.repartition('k')\n    d.repartition(8)\n    d.coalesce(2)\n    d.coalesce(True)\n",
                {("spark.large_take", 4), ("spark.large_take", 5), ("spark.repartition_no_key", 9)}),
    "loops.py": ("s = ''\nfor a in xs: s += 'x'\ns += 'y'\nwhile True:\n    s += 'z'\nelse:\n    s += 'w'\n"
                 "t = f''\nfor a in xs:\n    t += 'x'\n",
                 {("py.string_concat_loop", 2), ("py.string_concat_loop", 5), ("py.string_concat_loop", 7)}),
    "nested.py": ("for a in o.xs:\n    for b in o.xs:\n        pass\n    if a:\n        for c in o.xs:\n            pass\n"
                  "for a in f():\n    for b in f():\n        pass\nfor a in xs:\n    pass\nelse:\n    for b in xs:\n        pass\n",
                  {("py.nested_same_iterable", 2)}),
    "handles.py": ("with open('a') as f, open('b') as g:\n    f.read()\n    g.read(5)\nf.read()\nh = open('c')\nh.read()\n"
                   "h = 1\nh.read()\np.read_bytes()\n", {("py.read_all", 2), ("py.read_all", 6), ("py.read_all", 9)}),
    "sleep.py": ("from time import sleep\nimport asyncio\nsleep(1)\nasyncio.sleep(1)\n", {("py.time_sleep", 3)}),
    "collects.py": ("import gc, pyspark\ngc.collect()\nq.collect()\nq.collect(5)\nq.collect(timeout=5)\n",
                    {("spark.collect", 3), ("spark.collect", 5)}),
    "plain_collect.py": ("q.collect()\n", set()),
    "udfs.py": ("from pyspark.sql import functions as F\nfrom pyspark.sql.functions import pandas_udf as pu\n@F.udf\ndef a(v):\n"
                "    return v\n@pu('int')\ndef b(v):\n    return v\nc = pu(b)\nd = F.udf(b)\n",
                {("spark.python_udf", 3), ("spark.python_udf", 6), ("spark.python_udf", 9)}),
    "capped.py": ("".join(f"d{i}.iterrows()\n" for i in range(9)), {("py.pandas_iterrows", i) for i in range(1, 10)}),
    "node_modules/skip.py": ("df.iterrows()\n", set()),
    "upper.PY": ("df.iterrows()\n", {("py.pandas_iterrows", 1)}),
    # --- files that cannot be read
    "dedent.py": ("def f(df):\n        df.iterrows()\n    df.iterrows()\n", set()),
    "dedent_all.py": ("import pandas as pd\ndef f(df):\n        df = pd.DataFrame()\n    df.apply(len)\n", set()),
    "indent.py": ("x = 1\n  df.iterrows()\n", set()),
    "first_indent.py": ("  df.iterrows()\n", set()),
    "no_block.py": ("df.iterrows()\nif x:\ny = 1\n", set()),
    "block_at_end.py": ("df.iterrows()\nif x:\n", set()),
    "assigned.py": ("df.iterrows()\n1 = x\n", set()),
    "no_comma.py": ("df.iterrows()\nx = [1 2]\n", set()),
    "no_comma_call.py": ("df.iterrows()\nf(a b)\n", set()),
    "open_end.py": ("df.iterrows()\nx = 1 +\n", set()),
    "comma_text.py": ("df.iterrows()\nf(a 'b')\n", set()),
    "readable.py": ("@deco\nclass A(B, metaclass=C):\n    x: int = 1; y = -1\n\n    async def f(self, *a, b=1, **c) -> int:\n"
                    "        async with a as b, c as d:\n            return await b\n        return [x for x in a if x] or {**c}\n"
                    "match x:\n    case [1, y]: pass\n    case {'a': 1} | None:\n        pass\n    case -1:\n        pass\n"
                    "type T = int\nx = f'{x!r:>{w}} {y:10.2f} {z:0>5d} {x=} {a:%Y-%m-%d}' 'b' f\"c\"\nif (\n  x\n    ): y\nelse: z\n"
                    "for i in range(3): pass\nx = \\\n  1\nprint(*a, **b)\nx = a if b else c\nfrom m import *\nx = lambda *a, **k: (a, k)\n"
                    "try:\n\tx\nexcept* E as e:\n\traise X from e\nfinally:\n\tdel x[1:2, ::3]\ndf.iterrows()\n", {("py.pandas_iterrows", 34)}),
    "names.py": (r'q = "\N{SPACE}SELECT DISTINCT a FROM orders"' + "\n" + r'r = "\N{no such name} SELECT * FROM orders"' + "\n",
                 {("sql.distinct", 1)}),
    "nested_fields.py": ("s = f\"{f'{df.iterrows()}'}\"\nt = f\"\"\"{f'{f\"{df.itertuples()}\"}'}\"\"\"\nu = f'{x:{w}}' + f'{ {1: 2}[1] }'\n",
                         {("py.pandas_iterrows", 1), ("py.pandas_itertuples", 2)}),
    # --- SQL edges
    "count.sql": ("SELECT COUNT(*), a * b FROM t LIMIT 1\n", set()),
    "t_star.sql": ("SELECT t.*,\n  u.x\nFROM t JOIN u ON t.a = u.a\n", {("sql.select_star", 1)}),
    "quoted.sql": ("SELECT a FROM t WHERE 'it''s -- LIKE %' = b /* SELECT DISTINCT * */ AND LENGTH('x y') < c\n", set()),
    "backslash.sql": ("SELECT *\nFROM t\nWHERE p = 'C:\\dir\\' AND q LIKE '%y'\n",
                      {("sql.select_star", 1), ("sql.leading_wildcard_like", 3)}),
    "escape.sql": ("SELECT * FROM t WHERE p = 'a\\'b' AND q LIKE '%y'\n", {("sql.select_star", 1), ("sql.leading_wildcard_like", 1)}),
    "functions.sql": ("SELECT x FROM t WHERE LEFT(n, 3) = 'abc'\n AND REPLACE(n, '-', '') = 'a'\n AND LOWER(a) NOT LIKE 'x%'\n"
                      " AND CASE WHEN a > 1 THEN b END = 'x'\n AND doc ->> 'k' = 'x'\n AND a LIKE (('%x'))\n",
                      {("sql.leading_wildcard_like", 6), *[("sql.function_on_column", i) for i in range(1, 6)]}),
    "no_functions.sql": ("SELECT REPLACE(a, 'b', 'c') FROM t LEFT JOIN u ON t.k = u.k GROUP BY a HAVING MAX(a) = 1\n", set()),
    "having.sql": ("SELECT a FROM t GROUP BY a HAVING COUNT(*) > 1 AND UPPER(a) = 'X'\n", {("sql.function_on_column", 1)}),
    "select_side.sql": ("SELECT LOWER(a) = 'x' FROM t\n", set()),
    "join_on.sql": ("SELECT a.x FROM a JOIN b\n  ON LOWER(a.k) = b.k\n", {("sql.function_on_column", 2)}),
    "nested_filter.sql": ("SELECT x FROM t WHERE (a = 1 OR (b = 2 AND\n LOWER(c) = 'x'))\n", {("sql.function_on_column", 2)}),
    "arith.sql": ("SELECT x FROM t WHERE 1 + LOWER(c) = 'x' AND a BETWEEN LOWER(b) AND 2\n", set()),
    "window.sql": ("SELECT ROW_NUMBER() OVER (PARTITION BY a ORDER BY b) FROM t\n", set()),
    "sub_order.sql": ("SELECT x FROM (SELECT x FROM t\n ORDER BY x) q LIMIT 5\n", {("sql.order_without_limit", 2)}),
    "union.sql": ("SELECT a FROM t UNION SELECT a FROM u ORDER BY a\n", set()),
    "in.sql": ("SELECT a FROM t WHERE a IN (SELECT b FROM u)\n AND c IN (1, 2)\n AND NOT (d IN (SELECT e FROM v))\n",
               {("sql.in_subquery", 1), ("sql.in_subquery", 3)}),
    "distinct.sql": ("SELECT COUNT(DISTINCT a) FROM t;\nSELECT DISTINCT a FROM t\n", {("sql.distinct", 2)}),
    "comma.sql": ("SELECT a.x FROM a, b\n", set()),
    "corr.sql": ("SELECT a.x FROM a WHERE a.y > (\n  SELECT MAX(b.y) FROM b\n  WHERE b.k = a.k)\n", {("sql.correlated_subquery", 2)}),
    "uncorr.sql": ("SELECT a.x FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = k)\n", set()),
    "like.sql": ("SELECT a FROM t WHERE a NOT LIKE ('%x') AND b LIKE 'x%' AND c LIKE '%' || d\n", {("sql.leading_wildcard_like", 1)}),
    "open.sql": ("SELECT * FROM (SELECT 1\n", set()),
    # --- brackets around operands
    "brackets.sql": ("SELECT x FROM t WHERE (LOWER(a)) = 'x'\n OR ((LOWER(a))) = 'x'\n OR 'x' = (LOWER(a))\n"
                     " OR 'x' = ((((LOWER(a)))))\n OR a LIKE (((('%x'))))\n OR ((a::int)) = 3\n OR 3 < ( -- note\n (CASE WHEN a > 1 THEN b END))\n"
                     " OR (doc ->> 'k') = 'x' OR (TRIM((a))) NOT LIKE 'x%'\n",
                     {*[("sql.function_on_column", i) for i in (1, 2, 3, 4, 6, 8, 9)], ("sql.leading_wildcard_like", 5)}),
    "no_brackets.sql": ("SELECT x FROM t WHERE 1 + (LOWER(a)) = 'x' AND (LOWER(a)) + 1 = 'x' AND (LOWER(a) || b) = 'x'\n"
                        " AND (LOWER('a')) = b AND 'x' = (LOWER(a)) || b AND a IN ((LOWER(b))) AND (a = b) AND COUNT((*)) = 1\n", set()),
    "deep.sql": ("SELECT x FROM t WHERE " + "(" * 300 + "LOWER(a)" + ")" * 300 + " = 'x'\n", {("sql.function_on_column", 1)}),
    # --- correlation
    "unknown.sql": ("SELECT a.x FROM a WHERE EXISTS (\n SELECT 1 FROM b WHERE b.k = zz.k)\n", {("sql.correlated_subquery", 2)}),
    "cte_name.sql": ("WITH c AS (SELECT 1 AS k), d (k) AS (SELECT zz.k FROM y)\nSELECT c.k FROM c WHERE EXISTS (\n"
                     " SELECT 1 FROM b WHERE b.k = d.k AND b.j = c.j)\n", set()),
    "schema_name.sql": ("SELECT x FROM s.a WHERE EXISTS (SELECT 1 FROM s.b WHERE s.b.k = b.j)\n AND EXISTS (\n SELECT 1 FROM s.b WHERE b.k = s.a.k)\n",
                        {("sql.correlated_subquery", 3)}),
    "renamed.sql": ("SELECT x FROM a WHERE EXISTS (\n SELECT 1 FROM b bb WHERE b.k = 1)\n AND EXISTS (SELECT 1 FROM b AS c WHERE c.k = 1)\n",
                    {("sql.correlated_subquery", 2)}),
    "table_query.sql": ("SELECT x FROM a, (SELECT zz.k FROM b) q, (SELECT c.k FROM c) r\n", set()),
    "two_deep.sql": ("SELECT x FROM a WHERE a.k IN (\n SELECT b.k FROM b WHERE EXISTS (\n SELECT 1 FROM c WHERE c.k = a.k))\n",
                     {("sql.in_subquery", 1), ("sql.correlated_subquery", 2), ("sql.correlated_subquery", 3)}),
    "update.sql": ("UPDATE t SET x = (SELECT MAX(b.y) FROM b WHERE b.k = t.k)\n", set()),
    "table_sample.sql": ("SELECT a.x FROM a WHERE EXISTS (SELECT 1 FROM b TABLESAMPLE (5 ROWS) WHERE b.k = 1)\n"
                         " AND EXISTS (SELECT 1 FROM g(1) t(x, y) WHERE t.x = 1)\n", set()),
    # --- readings
    "hash.sql": ("# it's a note\nSELECT * FROM t -- it's\nWHERE q LIKE '%y' # the rest isn't\n",
                 {("sql.select_star", 2), ("sql.leading_wildcard_like", 3)}),
    "hash_first.sql": ("# a note\nSELECT DISTINCT a,\n # SELECT * FROM u\n b FROM t\n", {("sql.distinct", 2)}),
    "hash_sign.sql": ("SELECT * FROM t WHERE a # b = 1 AND c = '#'\n", {("sql.select_star", 1)}),
    "dollar.sql": ("SELECT * FROM t WHERE p = $$it's$$ AND q LIKE '%y'\n AND r LIKE $m$%it's$$ $m$\n",
                   {("sql.select_star", 1), ("sql.leading_wildcard_like", 1), ("sql.leading_wildcard_like", 2)}),
    "dollar_lines.sql": ("SELECT $$a\nSELECT DISTINCT x\n$$ AS a,\n t.* FROM t\n", {("sql.select_star", 4)}),
    # --- SQL in other files
    "embedded.py": ('q = ("SELECT * "\n     "FROM t WHERE id = 1")\nr = "SELECT *"\ns = f"select * from {t} where x like \'%a\'"\n',
                    {("sql.select_star", 1)}),
    "behind_field.py": ('q = f"{hint} SELECT * FROM orders ORDER BY x"\n', {("sql.select_star", 1), ("sql.order_without_limit", 1)}),
    "escaped.py": (r'q = "\x53ELECT * FROM orders WHERE a\u0020LIKE \'\45y\'"' + "\n",
                   {("sql.select_star", 1), ("sql.leading_wildcard_like", 1)}),
    "split_verb.py": ('q = "SEL" "ECT DISTINCT a FROM orders"\n', {("sql.distinct", 1)}),
    "Main.scala": ('val a = s"x"\n// "\n', set()),
    "App.scala": ('val a = """\n SELECT *\n FROM t\n WHERE x LIKE "%y" """\n', {("sql.select_star", 2), ("sql.leading_wildcard_like", 4)}),
}


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [("r", "main", path, "", len(text), text) for path, (text, _) in CASES.items()]
    files = spark.createDataFrame(rows, "repo string, ref string, path string, sha string, size bigint, content string")
    found = {}
    for row in audit.candidates(files).collect():
        found.setdefault(row.file_path, []).append(row)
    return found


@pytest.mark.parametrize("path", list(CASES))
def test_hits(scanned, path):
    got = {(row.rule_id, row.start_line) for row in scanned.get(path, [])}
    assert got == CASES[path][1]


def test_long_chains_of_assignments(spark):
    """A tag goes through any number of assignments, and three times as many take about three times as long."""
    def seconds(n):
        text = "import pandas as pd\nx0 = pd.DataFrame()\n" + "".join(f"x{k} = x{k - 1}\n" for k in range(1, n)) + f"x{n - 1}.apply(len)\n"
        files = spark.createDataFrame([("r", "main", "a.py", "", len(text), text)],
                                      "repo string, ref string, path string, sha string, size bigint, content string")
        start = time.time()
        rows = audit.python_hits(audit.scannable(files, 1), ["py.pandas_apply"]).collect()
        assert [r.start_line for r in rows] == [n + 2]
        return time.time() - start

    seconds(10)
    assert seconds(48_000) < 3.5 * seconds(16_000)


def test_lines_and_snippets(scanned):
    row = next(r for r in scanned["nested.py"] if r.rule_id == "py.nested_same_iterable")
    assert (row.start_line, row.end_line) == (2, 3)
    row = next(r for r in scanned["corr.sql"] if r.rule_id == "sql.correlated_subquery")
    assert (row.start_line, row.end_line) == (2, 3)
    row = next(r for r in scanned["no_newline.py"] if r.rule_id == "py.time_sleep")
    assert row.snippet == "import time\ntime.sleep(1)" and row.language == "python"


def test_loop_depth_against_ast(spark):
    """Loop depth per line against Python's own parser."""
    texts = {p: t for p, (t, _) in CASES.items() if p.endswith(".py") and "/" not in p}
    want = set()
    for path, text in texts.items():
        try:
            tree = ast.parse(text)
        except SyntaxError:
            continue

        def walk(node, depth, path=path):
            inner = depth + isinstance(node, (ast.For, ast.AsyncFor, ast.While))
            if isinstance(node, ast.stmt) and inner:
                want.add((path, node.lineno, inner))
            for child in ast.iter_child_nodes(node):
                walk(child, inner)

        walk(tree, 0)
    rows = [("r", "main", path, "", len(text), text) for path, text in texts.items()]
    files = audit.scannable(spark.createDataFrame(
        rows, "repo string, ref string, path string, sha string, size bigint, content string"))
    lines = rules_py.python_lines(files.where("suffix = '.py'")).join(files.select("file_id", "path"), "file_id")
    got = {(r.path, r.line, r.loop_depth) for r in lines.where((F.col("loop_depth") > 0) & (F.col("head") != "else")).select(
        "path", "line", "loop_depth").collect()}
    assert got == {(p, line, max(d for q, m, d in want if (q, m) == (p, line))) for p, line, _ in want}


def test_plan_sends_no_contents_around(spark):
    """Only the rule catalog is broadcast; files are dealt out by file_id and by nothing else."""
    rows = [("r", "main", path, "", len(text), text) for path, (text, _) in CASES.items()]
    files = spark.createDataFrame(rows, "repo string, ref string, path string, sha string, size bigint, content string")
    plan = audit.candidates(files, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("ShuffledHashJoin") >= 1
    dealt = [line for line in plan.splitlines() if " Exchange " in line]
    assert all("hashpartitioning(file_id" in line for line in dealt)


def test_files_are_read_and_shuffled_once(spark, tmp_path):
    """All branches of a plan take their files from one scan and one exchange; the audit is in a summary once."""
    rows = [("r", "main", path, "", len(text), text) for path, (text, _) in CASES.items()]
    spark.createDataFrame(rows, "repo string, ref string, path string, sha string, size bigint, content string").write.parquet(
        str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Window [")
    candidates, report = audit.candidates(files, 8), audit.scan_report(files, 8)
    assert count(audit.summary(files, 8)) <= count(candidates)
    for name, df in (("candidates", candidates), ("report", report)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        by_file = [line for line in plan.splitlines() if " Exchange hashpartitioning(file_id" in line and "Reused" not in line]
        assert len(scans) == 1 and len(by_file) == 1, name
        assert plan.count("ReusedExchange") >= 3, name
