"""Files with equal texts, and with texts that give the same lines, are read once a partition; each has its own rows."""

import pytest
from pyspark.sql import functions as F

from codesift.functions import text as X
from codesift.operators import tokens as TK
from codesift.plans import audit
from codesift.plans.derived import Tables
from codesift.plans.queries import methods, shared_partitions, with_path

SCHEMA = "repo string, ref string, path string, sha string, size bigint, content string"


def source(spark, texts):
    return spark.createDataFrame([("r", "main", path, "", len(text), text) for path, text in texts], SCHEMA)


def test_copies_are_read_once_a_partition(spark):
    """300 copies in 4 partitions make the tokens of at most 4 texts, and every copy has the hit."""
    copies = [(f"a{k}.py", "import pandas\ndf.iterrows()\n") for k in range(300)]
    f = audit.scannable(source(spark, [*copies, ("b.py", "x = 1\ndf.iterrows()\n"), ("c.py", "df.iterrows(\n")]), 4)
    assert TK.python_tokens(f).select("file_id").distinct().count() <= 4 + 2
    assert f.where("path LIKE 'a%'").select(F.spark_partition_id()).distinct().count() > 1  # copies are spread
    got = with_path(audit.python_hits(f, ["py.pandas_iterrows"]), f).select("file_path", "start_line").collect()
    assert sorted(map(tuple, got)) == sorted([(p, 2) for p, _ in copies] + [("b.py", 2)])


def test_a_file_listed_twice_has_its_hits_twice(spark):
    f = audit.scannable(source(spark, [("a.py", "df.iterrows()\n")] * 2 + [("b.py", "df.iterrows()\n")]), 2)
    got = with_path(audit.python_hits(f, ["py.pandas_iterrows"]), f).select("file_path", "start_line").collect()
    assert sorted(map(tuple, got)) == [("a.py", 1), ("a.py", 1), ("b.py", 1)]


def test_texts_alike_but_for_a_number(spark):
    """They are one text to the rules, and every file keeps its own snippet; a text with another line is not one of them."""
    texts = [("a.sql", "SELECT * FROM t123\n"), ("b.sql", "SELECT * FROM t456\n"), ("c.sql", "\nSELECT * FROM t456\n")]
    files = source(spark, texts)
    f = audit.scannable(files, 1, lines_only=True)
    assert f.select("file_id").distinct().count() == 2
    assert audit.scannable(files, 1).select("file_id").distinct().count() == 3
    got = {(r.file_path, r.start_line, r.snippet) for r in audit.candidates(files, 1).where(
        "rule_id = 'sql.select_star'").select("file_path", "start_line", "snippet").collect()}
    assert got == {("a.sql", 1, "SELECT * FROM t123"), ("b.sql", 1, "SELECT * FROM t456"), ("c.sql", 2, "\nSELECT * FROM t456")}


@pytest.mark.parametrize("text, want", [
    ("SELECT * FROM t123 JOIN u123", "SELECT * FROM t000 JOIN u000"),
    ("o.take(1000) o77777", "o.take(1000) o00000"),
    ("a1b234 c777", "a1b234 c000"),
    ("1.5e100 0x123 t555", "1.5e100 0x123 t000"),
    (r"\N{SPACE}some_5555", r"\N{SPACE}some_0000"),
    # several numbers, the number or as many zeros elsewhere, escapes, numbers, names of characters
    *[(t, t) for t in ["t123 t124", "t123 x000", "t123 000", "take(123) t123", "t123abc t123", r"\t123", r"t123 \x123",
                       "1.e123", "1e123", r"\N{HIEROGLYPH A001} t555", "t12 t45", "", None]]])
def test_without_number(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.without_number(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text", ["SELECT * FROM t123 JOIN u123", "o.take(1000) o77777", "a1b234 c777", "t100000 = 1\n\nu100000()", "t123 t124", "", None])
def test_a_number_is_put_back(spark, text):
    s = X.split_number(F.col("t"))
    assert spark.createDataFrame([(text,)], "t string").select(X.with_number(s["text"], s["number"])).first()[0] == text


def test_names_with_a_number_are_read_once(spark, tmp_path):
    """Names queries tokenize texts that differ by a number once a partition, and give each file its own names."""
    f = audit.scannable(source(spark, [(f"a{k}.py", f"import m{k}\nwith open(p{k}) as h{k}:\n    h{k}.read()\n") for k in (123, 456, 789)]), 1, True)
    assert TK.python_tokens(f).select("file_id").distinct().count() == 1
    assert {tuple(r) for r in methods(f).select("file_path", "line", "root").collect()} == {
        (f"a{k}.py", 3, f"h{k}") for k in (123, 456, 789)}


def test_few_large_partitions_where_texts_are_shared(spark, tmp_path):
    """Rows that repeat are counted, not weighed; queries that read equal texts once take an eighth of the partitions."""
    spark.range(9_000_000).selectExpr("0L AS o_orderkey", "0L AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    t = Tables(spark, str(tmp_path))
    assert t.partitions("orders") == 9_000_000 * 136 // (4 << 20)
    assert shared_partitions(t) == 9_000_000 * 136 // (32 << 20)
