"""The 16 rules on Python and PySpark calls, loops and assignments: resolved uses -> hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.operators import pyfacts as P
from codesift.operators import tokens as TK

# Words of which a file with a hit has at least one: a method's name, an imported name that ends in udf or sleep, a
# string +=, or two for loops.
WORDS = {
    "py.pandas_iterrows": "iterrows", "py.pandas_itertuples": "itertuples", "py.pandas_apply": "apply",
    "py.string_concat_loop": r"\+=", "py.nested_same_iterable": r"\bfor\b[\s\S]*?\bfor\b", "py.read_all": "read",
    "py.time_sleep": "sleep", "spark.collect": "collect", "spark.to_pandas": "toPandas", "spark.count_in_loop": "count",
    "spark.python_udf": "udf", "spark.rdd_action": "rdd", "spark.coalesce_one": "coalesce",
    "spark.cartesian": "crossJoin|cartesian", "spark.repartition_no_key": "repartition", "spark.large_take": "take",
}

# (rule, method names, whether the receiver is one plain name, what must hold of the call besides)
METHOD_RULES = [
    ("spark.large_take", ["take"], False, "int_arg >= 1000 AND spark_rooted"),  # fixed value
    ("spark.repartition_no_key", ["repartition"], False, "int_arg IS NOT NULL AND spark_rooted"),
    ("spark.coalesce_one", ["coalesce"], False, "int_arg = 1 AND spark_rooted"),
    ("spark.cartesian", ["crossJoin", "cartesian"], False, "true"),
    ("spark.to_pandas", ["toPandas"], False, "true"),
    ("spark.count_in_loop", ["count"], False, "zero_args AND loop_depth > 0 AND spark_rooted"),
    ("spark.collect", ["collect"], False,
     "no_positional AND NOT (asked IS NOT NULL AND hops = 1 AND asked = 'gc') AND (spark_rooted OR is_spark)"),
    ("spark.rdd_action", P.RDD_ACTIONS, False, "on_rdd"),
    ("py.pandas_apply", ["apply"], False, "pandas_rooted"),
    ("py.pandas_iterrows", ["iterrows"], False, "true"),
    ("py.pandas_itertuples", ["itertuples"], False, "true"),
    ("py.read_all", ["read_text", "read_bytes"], False, "true"),
    ("py.read_all", ["read"], True, "zero_args AND is_handle"),
    ("py.time_sleep", ["sleep"], True, "module = 'time'"),
]


def triggers(rules: list[str] | None = None) -> str:
    return "|".join(pattern for rule, pattern in WORDS.items() if rules is None or rule in rules)


def method_rule() -> Column:
    """Rule of a method call x.name(...). The names are disjoint, so a call gives at most one rule."""
    plain = F.col("asked").isNotNull() & (F.col("hops") == 1)
    return F.coalesce(*[
        F.when(F.col("name").isin(names) & F.expr(holds) & (plain if one_name else F.lit(True)), rule)
        for rule, names, one_name, holds in METHOD_RULES])


def name_rule() -> Column:
    """Rule of a bare call, a decorator or a string +=."""
    qualified = F.col("qualified")
    is_udf = (
        qualified.endswith(".udf") | qualified.endswith(".pandas_udf")
        | (F.col("is_spark") & F.col("name").isin(P.UDF_NAMES))
    )
    of_functions = F.contains(F.col("module"), F.lit("pyspark")) & F.contains(F.col("module"), F.lit("functions"))
    one_dot = F.col("dotted") & (F.col("hops") == 1)
    return (
        F.when((F.col("etype") == "call") & is_udf, "spark.python_udf")
        .when((F.col("etype") == "call") & (qualified == "time.sleep"), "py.time_sleep")
        .when((F.col("etype") == "deco") & ~F.col("dotted") & is_udf, "spark.python_udf")
        .when((F.col("etype") == "deco") & F.col("dotted") & (F.col("is_spark") | (one_dot & of_functions)),
              "spark.python_udf")
        .when((F.col("etype") == "concat") & (F.col("loop_depth") > 0) & (F.col("tag") == "string"),
              "py.string_concat_loop")
    )


def python_lines(files: DataFrame) -> DataFrame:
    """Logical lines of readable Python files with their events and enclosing blocks."""
    return P.enclosing_blocks(P.line_events(P.call_chains(P.token_events(TK.python_tokens(files)))))


def python_names(files: DataFrame) -> DataFrame:
    return P.names_per_file(P.name_rows(P.nested_pairs(python_lines(files))))


#: Rules on calls by name alone: they need no scopes and no assignments.
NAME_ONLY = ["py.pandas_iterrows", "py.pandas_itertuples", "spark.cartesian", "spark.to_pandas", "spark.rdd_action"]


def _plain_calls(files: DataFrame, rules: list[str]) -> DataFrame:
    """Hits of NAME_ONLY rules from the tokens and their chains."""
    chained = P.call_chains(P.token_events(TK.readable(TK.python_tokens(files), ends=True)))
    names = {n: rule for rule, names, _, holds in METHOD_RULES for n in names if rule in rules}
    rule = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("tok")]
    wanted = (F.col("etype") == "method") & F.col("tok").isin(list(names))
    levels = P.with_levels(
        chained.where(wanted | F.col("own").isNotNull()), F.col("own.hdr"), F.col("own.indent"), "pos")
    broken = F.max(P.wrong_dedent(F.col("own.indent")) & (F.col("kind") != "end")).over(Window.partitionBy("file_id"))
    return levels.withColumn("broken", broken).where(~F.col("broken") & wanted).withColumn("rule_id", rule).where(
        (F.col("rule_id") != "spark.rdd_action") | F.col("args.on_rdd")).select(
        "file_id", F.lit(0).alias("unit_no"), "rule_id", F.col("chain.line").cast("int").alias("start_line"),
        F.col("call_end").cast("int").alias("end_line"), "pos", F.lit(None).cast("string").alias("why"))


def python_hits(files: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Raw hits of the Python and Spark rules, or at least of some: file_id, unit_no (0), rule_id, start_line, end_line, pos,
    why.

    A file that cannot be read gives one row of the rule `unreadable`, with its first wrong line and the reason in why.
    """
    if rules is not None and set(rules) <= set(NAME_ONLY):
        return _plain_calls(files, rules)
    rule = F.when(F.col("etype") == "bad", F.lit("unreadable")).when(
        F.col("etype") == "nested", F.lit("py.nested_same_iterable")).when(
        F.col("etype") == "method", method_rule()).otherwise(name_rule())
    return (
        P.resolved_uses(python_names(files)).withColumn("rule_id", rule)
        .where(F.col("rule_id").isNotNull())
        .select("file_id", F.lit(0).alias("unit_no"), "rule_id",
                F.col("line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "pos",
                F.when(F.col("etype") == "bad", F.col("name")).alias("why"))
    )
