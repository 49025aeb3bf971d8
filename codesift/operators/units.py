"""SQL texts found in files: whole .sql files and the string literals of Python and Scala files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift import schemas as S
from codesift.functions import text as X
from codesift.operators import tokens as TK

_QUOTES = "(\"\"\"|'''|\"|')"


_ESCAPED = r"\\(?:N\{[^}]*+\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|[\s\S])|[^\\]+|\\"
_PLAIN = {"\\\n": "", "\\n": "\n", "\\t": "\t", "\\r": "\r", "\\'": "'", '\\"': '"', "\\\\": "\\", "\\f": "\f",
          "\\v": "\v", "\\a": "\a", "\\b": "\b"}


def _decode(body: Column) -> Column:
    """Escapes of a Python literal, piece by piece; unknown escapes and unknown names stay as they are."""

    def character(code: Column) -> Column:
        number = code.cast("int")  # as two 16-bit units where it needs them, which decode() reads
        wide = F.concat(F.lpad(F.hex(F.lit(0xD800) + F.shiftright(number - 0x10000, 10)), 4, "0"),
                        F.lpad(F.hex(F.lit(0xDC00) + (number - 0x10000).bitwiseAND(F.lit(0x3FF))), 4, "0"))
        units = F.when(number < 0x10000, F.lpad(F.hex(number), 4, "0")).otherwise(wide)
        return F.decode(F.unhex(units), "UTF-16BE")

    def piece(p: Column) -> Column:
        out = F.when(~p.startswith("\\"), p)
        for escape, char in _PLAIN.items():
            out = out.when(p == escape, char)
        return (
            # the virtual machine knows the names of characters
            out.when(p.rlike(r"^\\N\{"), F.coalesce(character(F.try_reflect(
                F.lit("java.lang.Character"), F.lit("codePointOf"), F.regexp_extract(p, r"\{(.*)\}", 1))), p))
            .when(p.rlike(r"^\\[xuU].."), character(F.conv(F.substring(p, F.lit(3), F.length(p)), 16, 10)))
            .when(p.rlike(r"^\\[0-7]"), character(F.conv(F.substring(p, F.lit(2), F.length(p)), 8, 10))).otherwise(p)
        )

    return F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_ESCAPED), F.lit(0)), piece), "")


def _literal_text(tok: Column, kind: Column, p1: Column, n1: Column) -> Column:
    """The value of one string token or of one literal piece of an f-string."""
    prefix = F.lower(F.regexp_extract(tok, "^([A-Za-z]{0,2})" + _QUOTES, 1))
    quote = F.regexp_extract(tok, "^[A-Za-z]{0,2}" + _QUOTES, 1)
    whole = F.substring(
        tok, F.length(prefix) + F.length(quote) + 1, F.length(tok) - F.length(prefix) - 2 * F.length(quote))
    opened = F.when(F.coalesce(p1, F.lit("")) == "}", tok).otherwise(
        F.regexp_replace(tok, "^[A-Za-z]{1,2}" + _QUOTES, ""))
    piece = F.when(F.coalesce(n1, F.lit("")) == "{", opened).otherwise(F.regexp_replace(opened, _QUOTES + "$", ""))
    piece = F.replace(F.replace(piece, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    body = F.when(kind == "fstr", piece).otherwise(whole)
    return F.when(F.contains(prefix, F.lit("r")) | ~F.contains(body, F.lit("\\")), body).otherwise(_decode(body))


def python_literals(files: DataFrame) -> DataFrame:
    """String literals of Python files: file_id, unit_no, start_line, text, is_spark. Adjacent literals are one."""
    order = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strings = (
        TK.readable(TK.python_tokens(files))
        .select("file_id", "is_spark", "pos", "tok", "kind", "line", "first", "p_kind", "p1", "n1")
        .where(F.col("kind").isin("str", "fstr"))
        .withColumn("opens", F.col("first") | ~F.col("p_kind").isin("str", "fstr"))
        .withColumn("literal", F.last(F.when(F.col("opens"), F.col("pos")), True).over(order))
        .withColumn("text", _literal_text(F.col("tok"), F.col("kind"), F.col("p1"), F.col("n1")))
    )
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return (
        strings.groupBy("file_id", "literal")
        .agg(F.min("line").cast("int").alias("start_line"), parts.alias("parts"),
             F.first("is_spark").alias("is_spark"), F.min(F.col("kind") == "fstr").alias("in_fstring"))
        .select("file_id", (F.col("literal") + 1).cast("int").alias("unit_no"), "start_line",
                F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "is_spark", "in_fstring")
        .where(~F.col("in_fstring") | (F.col("text") != ""))
        .drop("in_fstring")
    )


def scala_literals(files: DataFrame) -> DataFrame:
    """String literals of Scala files: file_id, unit_no, start_line, text. Comments are not understood."""
    order = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tok = F.col("tok")
    triple = tok.startswith('"""') & (F.length(tok) >= 6) & tok.endswith('"""')
    single = tok.startswith('"') & ~tok.startswith('"""') & (F.length(tok) >= 2) & tok.rlike(TK.SCALA_SINGLE)
    breaks = F.length(tok) - F.length(F.replace(tok, F.lit("\n"), F.lit("")))
    return (
        TK.one_per_text(files).select("file_id", F.posexplode(F.regexp_extract_all("content", F.lit(TK.SCALA_TOKEN), F.lit(0)))
                     .alias("pos", "tok"))
        .withColumn("start_line", (1 + F.sum(breaks).over(order) - breaks).cast("int"))
        .where(triple | single)
        .select(
            "file_id", (F.col("pos") + 1).alias("unit_no"), "start_line",
            F.when(triple, F.expr("substring(tok, 4, length(tok) - 6)"))
            .otherwise(F.regexp_replace(F.expr("substring(tok, 2, length(tok) - 2)"), r"\\([\s\S])", "$1")).alias("text"),
        )
    )


def sql_units(files: DataFrame, words: str = "") -> DataFrame:
    """Every SQL text of the files: file_id, unit_no, dialect, start_line, sql.

    Unit 0 is a whole .sql file, of those that match words; a literal is a unit when it looks like SQL.
    """
    texts = lambda suffix: TK.one_per_text(files.where(F.col("suffix") == suffix))
    whole = texts(".sql").where(F.col("content").rlike(words) if words else F.lit(True)).select(
        "file_id", F.lit(0).alias("unit_no"), F.lit("sql").alias("dialect"), F.lit(1).alias("start_line"),
        F.col("content").alias("sql"))
    columns = ["file_id", "unit_no", "dialect", "start_line", F.col("text").alias("sql")]

    def looking_like_sql(literals: DataFrame) -> DataFrame:
        return literals.where(X.looks_like_sql(F.col("text")))

    # a literal can be SQL only if its verb stands where a literal or a piece of an f-string starts, whole or split over
    # literals, or is spelled with an escape
    joint = r"(?:[\"']\s*[rbufRBUF]{0,2}[\"'])?"
    verbs = r"(?i)[\"'}](?:[\s(]|\\\n|[rbuf]{0,2}[\"'])*(?:" + "|".join(joint.join(v) for v in S.SQL_VERBS) + r")|\\[xuUN0-7]"
    python = texts(".py").where(F.col("content").rlike(verbs))
    in_python = looking_like_sql(python_literals(python)).withColumn(
        "dialect", F.when(F.col("is_spark"), "spark").otherwise("sql")).select(*columns)
    in_scala = looking_like_sql(scala_literals(texts(".scala"))).withColumn(
        "dialect", F.lit("spark")).select(*columns)
    return whole.unionByName(in_python).unionByName(in_scala)
