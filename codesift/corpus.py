"""A corpus of source files derived from the orders table: one file per order.

The text of a file is one of a few templates, chosen by the order key; repository and path come from the
keys too. It grows with the table and is used to exercise and measure the audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (suffix, text); @K@ stands for the order key.
TEMPLATES = [
    (".sql", """SELECT k.*, ROUND(k.load) AS r
FROM kiosk@K@ k
WHERE k.town LIKE '%ford'
   OR 7 < ROUND(k.load)
ORDER BY 2
"""),
    (".sql", """/* WITH x AS (SELECT * FROM y) */
SELECT DISTINCT p.kind
FROM parcel@K@ p
WHERE p.depot IN (
    SELECT d.id FROM depot d
  )
  AND NOT p.lane IN (SELECT r.lane FROM ramp r)
  AND 3 = LENGTH('abc')
FETCH FIRST 5 ROWS ONLY
"""),
    (".sql", """SELECT a.id, COUNT(*) AS n
FROM t@K@ a
WHERE EXISTS (
  SELECT 1 FROM v z
  WHERE z.id = a.id
)
GROUP BY a.id
HAVING COUNT(*) > 1
"""),
    (".sql", "SELECT * FROM a@K@;\n" * 9),
    (".sql", "SELECT * FROM (SELECT * FROM t@K@) q CROSS JOIN u LIMIT 5\n"),
    (".py", """import pandas as pd

def f(path):
    df = pd.read_csv(path)
    for i, r in df.iterrows():
        print(r)
    for r in df.itertuples():
        print(r)
    s = df["a"].apply(str)
    df = df.dropna()
    t = df["a"].apply(str)
    return s
"""),
    (".py", """import time
from time import sleep as nap

def g(path, items):
    out = ""
    for a in items:
        for b in items:
            out += str(b)
    time.sleep(1)
    nap(2)
    with open(path) as fh:
        body = fh.read()
        head = fh.read(10)
    return path.read_text()
"""),
    (".py", """from pyspark.sql import functions as F
from pyspark.sql.functions import udf

@udf("string")
def up(v):
    return v

def run(spark):
    o = spark.table("o@K@")
    r = o.collect()
    p = o.toPandas()
    while True:
        n = o.count()
        break
    x = o.crossJoin(o).coalesce(1)
    y = o.repartition(8)
    z = o.repartition(8, "k")
    a = o.take(999)
    b = o.take(1000)
    c = o.rdd.map(str)
    d = o.rdd.filter(bool).map(str)
    e = F.udf(up)
"""),
    (".py", """import gc

def h(spark, q):
    gc.collect()
    q.collect()
    rows = spark.load().collect()
    txt = 'x.collect()'
    # q.toPandas()
    return rows
"""),
    (".py", """def report(db):
    query = '''
      SELECT r.*
      FROM ramp@K@ r ORDER BY r.seen
    '''
    return db.run(query)
"""),
    (".scala", '''object A {
  val q = """
    SELECT DISTINCT a.id
    FROM t@K@ a
    """
  val r = "short"
  val s = "SELECT * FROM table_@K@ x"
}
'''),
    (".py", """for i, r in df.iterrows():
    print(r)
"""),
    (".txt", "SELECT * FROM t@K@ LIMIT 1\n"),
    (".py", """def f(:
    x.iterrows()
"""),
    (".py", """import pandas as pd

def tally(grid, seen):
    seen.apply(max)
    for row in grid:
        for cell in row:
            seen.add(cell)
    return len(seen)
"""),
    (".py", """from pyspark.sql import SparkSession
spark = SparkSession.builder.getOrCreate()
df = (
    spark.read.parquet("p")
    .where("a > 1")
)
rows = (
    df.select("a")
    .collect()
)
print(rows)
"""),
    (".py", """def q(h):
    return f"{h} SELECT * FROM t@K@ ORDER BY x"
"""),
    (".sql", """SELECT a FROM t@K@ WHERE LEFT(name, 3) = 'abc';
SELECT a FROM t WHERE REPLACE(name, '-', '') = 'abc';
SELECT a FROM t WHERE LOWER(a) NOT LIKE 'x%';
SELECT a FROM t WHERE CASE WHEN a > 1 THEN b ELSE c END = 'x';
SELECT a FROM t WHERE doc ->> 'k' = 'x';
SELECT a FROM t WHERE a LIKE (('%x'));
SELECT REPLACE(a, 'b', 'c') FROM t LEFT JOIN u ON t.k = u.k GROUP BY a HAVING MAX(a) = 1;
"""),
    (".sql", """SELECT *
FROM t@K@
WHERE p = 'C:\\dir\\' AND q LIKE '%y'
"""),
    (".py", """x = = 1
df.iterrows()
"""),
    (".sql", """SELECT a FROM t@K@ WHERE ((LOWER(a))) = 'x' OR 'x' = (LOWER(b));
SELECT a FROM t WHERE a LIKE (((('%x'))));
"""),
    (".sql", """# it's read by a nightly job
SELECT a.x FROM a@K@ a WHERE EXISTS (
  SELECT 1 FROM b WHERE b.k = zz.k
)
"""),
    (".sql", "SELECT DISTINCT a FROM t@K@ WHERE p = $$it's$$ AND q LIKE $m$%it's$m$\n"),
    (".py", """def f(df):
        df.iterrows()
    df.iterrows()
"""),
    (".py", """df.iterrows()
x = [1 2]
"""),
    (".py", """s = f"{f'{df.iterrows()}'}"
q = "\\N{SPACE}SELECT * FROM some_table_@K@"
"""),
]
SKIPPED_TEMPLATE = 11  # lives under node_modules


def code_corpus(orders: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """source_files (repo, ref, path, sha, size, content) with one file per order row, made in so many tasks."""
    key = F.col("o_orderkey")
    template = (key % len(TEMPLATES)).cast("int")
    suffix = F.element_at(F.array(*[F.lit(s) for s, _ in TEMPLATES]), template + 1)
    text = F.element_at(F.array(*[F.lit(t) for _, t in TEMPLATES]), template + 1)
    path = F.when(
        template == SKIPPED_TEMPLATE, F.concat(F.lit("node_modules/f"), key, F.lit(".py"))
    ).otherwise(F.concat(F.lit("src/m"), key % 100, F.lit("/f"), key, suffix))
    # the keys are spread before the texts are made, as the table may be one small file
    keys = orders.select("o_orderkey", "o_custkey")
    keys = keys.repartition(num_partitions, "o_orderkey") if num_partitions else keys.repartition("o_orderkey")
    return keys.select(
        F.concat(F.lit("repo_"), F.col("o_custkey") % 10).alias("repo"),
        F.lit("main").alias("ref"),
        path.alias("path"),
        F.replace(text, F.lit("@K@"), key.cast("string")).alias("content"),
    ).select(
        "repo", "ref", "path",
        F.sha1("content").alias("sha"),
        F.octet_length("content").cast("bigint").alias("size"),
        "content",
    )


def text_corpus(documents: DataFrame) -> DataFrame:
    """source_files with the text of every document in a comment or a literal, and one statement with a hit behind it.

    By doc_id % 4: a Python docstring, a SQL block comment, Python line comments, SQL line comments. Characters that would
    end the comment are left out of the text.
    """
    key = F.col("doc_id")
    text = F.translate(F.coalesce("text", F.lit("")), "\"\\/\r", "")
    behind = lambda mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))
    shape = F.pmod(key, F.lit(4))
    content = (
        F.when(shape == 0, F.concat(F.lit('"""'), text, F.lit('"""\nimport pandas\ndf.iterrows()\n')))
        .when(shape == 1, F.concat(F.lit("/*"), text, F.lit("*/\nSELECT * FROM t LIMIT 1\n")))
        .when(shape == 2, F.concat(behind("# "), F.lit("\nq.toPandas()\n")))
        .otherwise(F.concat(behind("-- "), F.lit("\nSELECT DISTINCT a FROM t\n"))))
    return documents.select(
        F.col("source").alias("repo"), F.lit("main").alias("ref"),
        F.concat(F.lit("d"), key, F.when(shape.isin(0, 2), ".py").otherwise(".sql")).alias("path"), content.alias("content"),
    ).select("repo", "ref", "path", F.sha1("content").alias("sha"),
             F.octet_length("content").cast("bigint").alias("size"), "content")
