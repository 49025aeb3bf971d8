"""Facts about Python files derived from token rows: call chains, imports, blocks, scopes and name tags.

The stages run one after the other on the same rows and all group by file_id first, so they stay inside the
partitions made by tokens.partition_files:

  tokens -> events -> chains (window per bracket level) -> events per logical line (group by line)
         -> enclosing blocks (window per indent level) -> names resolved as of their position (window per name)
         -> tags spread along assignments (one fold per file)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.functions import text as X
from codesift.operators import tokens as TK

# --- Fixed values: names the rules look for ---------------------------------------------------
UDF_NAMES = ["udf", "pandas_udf"]
RDD_ACTIONS = ["map", "flatMap", "foreach", "mapPartitions"]
RULE_METHODS = [
    "iterrows", "itertuples", "apply", "read_text", "read_bytes", "read", "sleep", "collect", "toPandas", "count",
    "coalesce", "crossJoin", "cartesian", "repartition", "take",
] + RDD_ACTIONS
MAX_HOPS = 30  # steps followed from a call back to the name it starts from
# --- End of fixed values ----------------------------------------------------------------------


#: What an assignment can make of a name, by number.
TAGS = ["", "pandas", "spark", "string", "file"]


def _is(name: str, *values: str) -> Column:
    return F.col(name).isin(*values)


def _integer(tok: Column) -> Column:
    digits = F.replace(tok, F.lit("_"), F.lit(""))
    return (
        F.when(digits.rlike("^[0-9]+$"), F.try_to_number(digits, F.lit("9" * 18)).cast("bigint"))
        .when(digits.rlike("^0[xX]"), F.conv(F.substring(digits, 3, 20), 16, 10).cast("bigint"))
        .when(digits.rlike("^0[oO]"), F.conv(F.substring(digits, 3, 30), 8, 10).cast("bigint"))
        .when(digits.rlike("^0[bB]"), F.conv(F.substring(digits, 3, 70), 2, 10).cast("bigint"))
    )


def token_events(tokens: DataFrame) -> DataFrame:
    """Mark the tokens the rules ask about and keep only what the later stages need of each token.

    Event types: method (x.name(...) a rule looks at), call (name(...)), deco (decorator), bind (assignment
    target), import (a token of an import statement), param (a Spark session parameter), handle (as name in a
    with), concat (name += ...). why tells what makes the file unreadable.
    """
    tok, kind, n1, n2, p1 = F.col("tok"), F.col("kind"), F.col("n1"), F.col("n2"), F.col("p1")
    is_name, top = kind == "name", F.col("lvl") == 0
    visited = ~F.col("in_def") & (F.col("ftok") != "@")
    in_import = F.col("s1").isin("import", "from") & (F.col("s1_kind") == "keyword") & (kind != "end")
    named = p1 == "."
    annotated = top & (tok == "=") & (F.col("s2") == ":") & (F.col("s1_kind") == "name") & ~F.col("hdr")
    etype = (
        F.when(in_import, "import")
        .when(is_name & named & (n1 == "(") & visited & tok.isin(RULE_METHODS), "method")
        .when(is_name & ~named & (n1 == "(") & visited & ~p1.isin("def", "class", "@"), "call")
        .when(is_name & (p1 == "@") & top & (F.col("ftok") == "@") & (F.col("p_pos") == F.col("first_pos"))
              & ((n1 == "(") | F.col("last")), "deco")
        .when(is_name & named & top & (F.col("ftok") == "@") & tok.isin(UDF_NAMES)
              & ((n1 == "(") | F.col("last")), "deco")
        .when(is_name & top & (n1 == "=") & (F.col("sstart") | (p1 == "=")) & ~F.col("in_hdr"), "bind")
        .when(annotated, "bind")
        .when(F.col("is_param") & (tok == "spark"), "param")
        .when(F.col("in_def") & (tok == "SparkSession") & is_name & ~named & (F.col("lvl") > 0) & (p1 != "=")
              & (F.coalesce("arrow", F.lit(-1)) != F.col("lline")), "param")
        .when((tok == "as") & (F.col("s1") == "with") & (p1 == ")") & n2.isin(":", ",", ")"), "handle")
        .when(is_name & F.col("sstart") & (n1 == "+="), "concat")
    )
    name = (
        F.when(F.col("etype") == "bind", F.when(tok == "=", F.col("s1")).otherwise(tok))
        .when(F.col("etype") == "param", F.when(tok == "spark", tok).otherwise(F.col("param")))
        .when(F.col("etype") == "handle", n1)
        .when(F.col("etype").isNotNull(), tok)
    )
    single = (F.col("n2_kind") == "number") & ((F.col("n3") == ")") | ((F.col("n3") == ",") & (F.col("n4") == ")")))
    no_positional = (n2 == ")") | (n2 == "**") | ((F.col("n2_kind") == "name") & (F.col("n3") == "="))
    in_iter = (
        F.col("in_hdr") & top & ~F.col("hcolon") & (tok != "in")
        & ((F.col("ftok") == "for") | ((F.col("ftok") == "async") & (F.col("f2") == "for")))
        & F.coalesce(F.col("after_in") == F.col("lline"), F.lit(False))
    )
    is_method = F.col("etype") == "method"
    closer = p1.isin(")", "]", "}") & (F.col("p_kind") == "op")
    value_before = F.col("p_kind").isin("name", "str", "fstr", "number") | closer
    goes_on = ~F.col("first") & (
        ((tok == ".") & (kind == "op") & (value_before | p1.isin("None", "True", "False")))
        | (kind.isin("name", "keyword") & named)
        | (tok.isin("(", "[") & (kind == "op") & (F.col("p_kind").isin("name", "str", "fstr") | closer))
        | (tok.isin(")", "]", "}") & (kind == "op"))
        | ((kind == "str") & (F.col("p_kind") == "str"))
    )
    return tokens.withColumn("etype", etype).select(
        "file_id", "is_spark", "pos", "tok", "kind", "line", "eline", "lvl", "lline", "stmt", "etype", "why", "wrong_line",
        name.alias("name"),
        F.when(F.col("first"), F.struct("indent", "ftok", "f2", "hdr", "line")).alias("own"), "last",
        (~goes_on).alias("starts"), p1.alias("before"), "p_pos",
        (n1 == ")").alias("closes"), (n1 == "(").alias("called"), named.alias("dotted"),
        F.when(is_method, F.struct(
            (n2 == ")").alias("zero_args"), no_positional.alias("no_positional"),
            F.when(single, _integer(n2)).alias("int_arg"), ((F.col("p2") == "rdd") & (F.col("p3") == ".")).alias("on_rdd"),
        )).alias("args"),
        in_iter.alias("in_iter"),
        (((F.col("last") & (tok != ";")) | (top & (n1 == ";"))) & top & ~in_import).alias("ends_stmt"),
        (F.col("s2") == "+=").alias("adds"),
    )


def call_chains(events: DataFrame) -> DataFrame:
    """Give each token the postfix chain (a.b(...)[c].d) it belongs to.

    A chain is a run of tokens at one bracket level without a break. Opening brackets appear twice: once at
    their own level and once as the first row (role 1) of the group they open.
    """
    opener = (F.col("kind") == "op") & _is("tok", "(", "[", "{")
    rows = events.withColumn(
        "role", F.explode(F.when(opener, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("glvl", F.col("lvl") + F.col("role"))
    order = Window.partitionBy("file_id", "glvl").orderBy("pos", "role")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = (F.col("role") == 1) | F.col("starts")
    hop = (F.col("role") == 0) & ~F.col("starts") & (_is("tok", ".", "(", "["))
    head = F.struct("pos", "tok", "kind", "line", "before", F.coalesce("p_pos", F.lit(-1)).alias("before_pos"))
    return (
        rows.withColumns({
            "group": F.last(F.when(F.col("role") == 1, F.struct("pos", "tok", "starts")), True).over(upto),
            "chain": F.last(F.when(begins, head), True).over(upto),
            "hops_run": F.sum(hop.cast("int")).over(upto),
            "call_end": F.lead("eline", 2).over(order),
            "l2": F.lag("tok", 2).over(order), "l3": F.lag("tok", 3).over(order),
        })
        .withColumn("hops", F.col("hops_run") - F.last(F.when(begins, F.col("hops_run")), True).over(upto))
        .where(F.col("role") == 0)
    )


def line_events(chained: DataFrame) -> DataFrame:
    """One row per logical line with its events. Besides those of token_events: value (the last token of a
    statement that ends in one chain), iter (iterated expression of a for), paren (a bracket around one chain)."""
    # `open(...) as f`: three rows back at the same level stands the callee
    etype = F.when((F.col("etype") == "handle") & (F.coalesce("l3", F.lit("")) != "open"), None).otherwise(F.col("etype"))
    is_value = F.col("ends_stmt") & ((F.col("chain.before") == "=") | F.col("adds"))
    in_paren = F.col("closes") & (F.col("group.tok") == "(") & F.col("group.starts") & (
        F.col("chain.before_pos") == F.col("group.pos"))
    event = F.struct(
        "pos", "stmt", F.coalesce("name", "tok").alias("name"), F.col("chain.line").alias("line"), "eline", "call_end",
        F.col("chain.tok").alias("root"), F.col("chain.kind").alias("root_kind"), F.col("chain.pos").alias("root_pos"),
        "hops", "dotted", "called", "args", F.col("group.pos").alias("group_pos"), F.col("kind").alias("end_kind"),
        F.col("l2").alias("callee"), "tok", F.col("before"),
    )
    any_kind = F.col("etype").isNotNull() | F.col("is_value") | F.col("in_iter") | F.col("in_paren")
    kinds = F.array("etype", F.when(F.col("is_value"), "value"), F.when(F.col("in_iter"), "iter"),
                    F.when(F.col("in_paren"), "paren"))
    return (
        # cheap flags first; the wide event struct is built for the few kept tokens only
        chained.withColumns({"etype": etype, "is_value": is_value, "in_paren": F.coalesce(in_paren, F.lit(False))})
        .where(F.col("own").isNotNull() | F.col("last") | any_kind | F.col("why").isNotNull())
        .select("file_id", "lline", "is_spark", "eline", "own",
                F.when(any_kind, F.struct(kinds.alias("kinds"), event.alias("e"))).alias("event"),
                (F.col("kind") != "end").alias("real"),
                F.when(F.col("why").isNotNull(), F.struct("pos", "why", "wrong_line")).alias("wrong"))
        .groupBy("file_id", "lline")
        .agg(
            F.first("is_spark").alias("is_spark"), F.first("own", ignorenulls=True).alias("own"),
            F.max(F.when(F.col("real"), F.col("eline"))).alias("eline"), F.min("wrong").alias("wrong"),
            F.max("real").alias("real"), F.collect_list("event").alias("events"),
        )
        .select(
            "file_id", "lline", "is_spark", "own.indent", "own.line", "own.hdr", "eline", "real",
            F.struct(F.col("wrong.wrong_line").alias("line"), "wrong.why").alias("wrong"),
            F.flatten(F.transform("events", lambda x: F.transform(
                F.filter(x["kinds"], lambda k: k.isNotNull()),
                lambda k: F.struct(k.alias("etype"), x["e"].alias("e"))))).alias("events"),
            F.when(F.col("own.ftok") == "async", F.col("own.f2")).otherwise(F.col("own.ftok")).alias("head"),
            (F.col("own.ftok") == "async").alias("is_async"),
        )
    )


def _iter_key(events: Column) -> Column:
    """The dotted name a for loop runs over, or NULL when it is anything else."""
    toks = F.filter(events, lambda x: x["etype"] == "iter")
    text = F.array_join(F.transform(F.array_sort(F.transform(toks, lambda x: F.struct(x["e"]["pos"], x["e"]["tok"]))),
                                    lambda t: t["tok"]), "")
    return F.when((F.size(toks) > 0) & text.rlike(r"^[\w\x{80}-\x{10FFFF}]+(?:\.[\w\x{80}-\x{10FFFF}]+)*$")
                  & ~text.rlike(r"^[0-9]"), text)


def with_levels(rows: DataFrame, hdr: Column, indent: Column, order: str) -> DataFrame:
    """Add levels (the indents at which the file opens blocks) and p_indent (that of the line before)."""
    before = Window.partitionBy("file_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("p_indent", F.last(indent, True).over(before)).withColumn(
        "levels", F.collect_set(F.when(hdr, indent)).over(Window.partitionBy("file_id")))


def wrong_dedent(indent: str | Column) -> Column:
    """A line goes back to where no block of the file starts."""
    indent = F.col(indent) if isinstance(indent, str) else indent
    return F.coalesce((indent < F.col("p_indent")) & ~F.array_contains("levels", indent), F.lit(False))


def enclosing_blocks(lines: DataFrame) -> DataFrame:
    """Give each logical line the chain of blocks around it (outermost first).

    A line is repeated once per indent at which the file opens blocks (Python allows at most 100). Within one
    such indent, the last line not indented deeper is the head of the block a deeper line is in.
    """
    lines = lines.withColumn("key", F.when(F.col("head") == "for", _iter_key(F.col("events"))))
    per_file = Window.partitionBy("file_id")
    why = F.coalesce("wrong.why", F.when(F.col("real") & wrong_dedent("indent"), TK.WHY["dedent"]))
    spread = (
        with_levels(lines, F.col("hdr"), F.col("indent"), "lline")
        .withColumn("wrong", F.when(why.isNotNull(), F.struct(F.coalesce("wrong.line", "line").alias("line"), why.alias("why"))))
        # the first wrong line of a file that cannot be read is all that stays of it
        .withColumn("first_wrong", F.min("wrong").over(per_file))
        .where(F.when(F.col("first_wrong").isNull(), F.col("real")).otherwise(F.col("wrong") == F.col("first_wrong")))
        .withColumn("events", F.when(F.col("wrong").isNull(), F.col("events")).otherwise(F.slice("events", 1, 0)))
        .withColumn("level", F.explode(F.concat(F.array(F.lit(-1)), F.col("levels"))))
        .withColumn("events", F.when(F.col("level") == -1, F.col("events")))
        .drop("levels", "first_wrong", "real", "p_indent")
    )
    order = Window.partitionBy("file_id", "level").orderBy("lline").rowsBetween(Window.unboundedPreceding, 0)
    outer = F.col("indent") <= F.col("level")
    head = F.struct("lline", "indent", "line", "head", "is_async", "key", "hdr")
    block = F.struct(
        "level", F.col("above.lline").alias("lline"), F.col("above.line").alias("line"),
        F.col("above.head").alias("head"), F.col("above.is_async").alias("is_async"), F.col("above.key").alias("key"),
        (F.col("above_head") == "else").alias("in_else"),
    )
    inside = (F.col("indent") > F.col("level")) & (F.col("above.indent") == F.col("level")) & F.col("above.hdr")
    return (
        spread.withColumns({
            "above": F.last(F.when(outer & (F.col("head") != "else"), head), True).over(order),
            "above_head": F.last(F.when(outer, F.col("head")), True).over(order),
        })
        .groupBy("file_id", "lline")
        .agg(
            F.first("is_spark").alias("is_spark"), F.first("line").alias("line"), F.first("eline").alias("eline"),
            F.first("head").alias("head"), F.first("is_async").alias("is_async"), F.first("key").alias("key"),
            F.first("hdr").alias("hdr"), F.first("wrong").alias("wrong"),
            F.first("events", ignorenulls=True).alias("events"),
            F.array_sort(F.collect_list(F.when(inside, block))).alias("blocks"),
        )
        .withColumns({
            "loop_depth": F.size(F.filter("blocks", lambda b: b["head"].isin("for", "while")))
            + (F.col("hdr") & _is("head", "for", "while")).cast("int"),
            "scopes": F.concat(
                F.array(F.lit(-1).cast("bigint")),
                F.transform(F.filter("blocks", lambda b: b["head"] == "def"), lambda b: b["lline"]),
                F.when(F.col("hdr") & (F.col("head") == "def"), F.array("lline")).otherwise(
                    F.array().cast("array<bigint>")),
            ),
        })
    )


def nested_pairs(lines: DataFrame) -> DataFrame:
    """Add `nested`: the for loops around (or on) a line whose direct parent is a for over the same dotted name."""
    own = F.struct(
        F.lit(1 << 20).alias("level"), F.col("lline"), F.col("line"), F.col("head"), F.col("is_async"), F.col("key"),
        F.lit(False).alias("in_else"),
    )
    none = F.array().cast("array<struct<line:bigint,lline:bigint>>")
    chain = F.when(F.col("hdr"), F.concat("blocks", F.array(own))).otherwise(F.col("blocks"))
    pairs = F.arrays_zip(
        F.slice("chain", 1, F.size("chain") - 1).alias("outer"), F.slice("chain", 2, F.size("chain") - 1).alias("inner")
    )
    same = F.filter(
        pairs,
        lambda p: (p["outer"]["head"] == "for") & (p["inner"]["head"] == "for") & ~p["inner"]["is_async"]
        & (p["outer"]["key"] == p["inner"]["key"]) & ~p["outer"]["in_else"],
    )
    found = F.transform(same, lambda p: F.struct(p["inner"]["line"].alias("line"), p["inner"]["lline"].alias("lline")))
    return lines.withColumn("chain", chain).withColumn(
        "nested", F.when((F.col("loop_depth") > 1) & (F.size("chain") > 1), found).otherwise(none)
    ).drop("chain")


_IMPORT = "etype:string,name:string,module:string,is_from:boolean,stmt:bigint"
_PAREN = "struct<at:int,root:string,root_kind:string,root_pos:int,hops:bigint,end_kind:string>"


def _open_parens(events: Column) -> Column:
    """The single-chain brackets of a line, each with the root found through any bracket nested at its start."""
    found = F.transform(
        F.filter(events, lambda x: x["etype"] == "paren"),
        lambda x: F.struct(
            x["e"]["group_pos"].alias("at"), x["e"]["root"].alias("root"), x["e"]["root_kind"].alias("root_kind"),
            x["e"]["root_pos"].alias("root_pos"), x["e"]["hops"].alias("hops"), x["e"]["end_kind"].alias("end_kind"),
        ),
    )

    def step(acc: Column, p: Column) -> Column:
        inner = F.get(F.filter(acc, lambda r: r["at"] == p["root_pos"]), F.lit(0))
        return F.concat(acc, F.array(_through(p, inner)))

    innermost_first = F.reverse(F.array_sort(found))
    return F.aggregate(innermost_first, F.array().cast(f"array<{_PAREN}>"), step)


def _through(p: Column, inner: Column) -> Column:
    """p, or what p's leading bracket holds."""
    deeper = inner.isNotNull() & (p["root"] == "(")
    return F.struct(
        p["at"].alias("at"),
        F.when(deeper, inner["root"]).otherwise(p["root"]).alias("root"),
        F.when(deeper, inner["root_kind"]).otherwise(p["root_kind"]).alias("root_kind"),
        p["root_pos"].alias("root_pos"),
        (p["hops"] + F.when(deeper, inner["hops"]).otherwise(F.lit(0))).alias("hops"),
        F.when(deeper & (p["hops"] == 0), inner["end_kind"]).otherwise(p["end_kind"]).alias("end_kind"),
    )


def _imports(events: Column) -> Column:
    """(stmt-ordered) imported names of a line: array of struct(local, module, from_import)."""
    toks = F.array_sort(F.transform(
        F.filter(events, lambda x: x["etype"] == "import"), lambda x: F.struct(x["e"]["pos"], x["e"]["tok"])))
    text = F.array_join(F.transform(toks, lambda t: t["tok"]), " ")
    # tokens are joined by one blank: "from a . b import ( c as d , e )"
    tidy = F.regexp_replace(F.regexp_replace(text, r" ?\. ?", "."), r"[()]", " ")

    def statement(stmt: Column) -> Column:
        from_part = F.regexp_extract(stmt, r"^\s*from\s*\.*\s*([^ ]*?)\s*import\b", 1)
        is_from = stmt.rlike(r"^\s*from\b")
        names = F.regexp_extract(stmt, r"\bimport\b(.*)$", 1)
        return F.transform(
            F.filter(F.split(names, ","), lambda n: F.trim(n) != ""),
            lambda n: F.struct(
                F.regexp_extract(F.trim(n), r"(\S+)$", 1).alias("local"),
                F.when(is_from & (from_part != ""), F.concat(from_part, F.lit("."), F.regexp_extract(F.trim(n), r"^(\S+)", 1)))
                .otherwise(F.regexp_extract(F.trim(n), r"^(\S+)", 1)).alias("module"),
                is_from.alias("is_from"),
            ),
        )

    return F.flatten(F.transform(F.split(tidy, ";"), statement))


def name_rows(lines: DataFrame) -> DataFrame:
    """Explode line events into rows: uses of a name the rules ask about, and events that change a name."""
    first_stmt = F.array_min(F.transform(F.filter("events", lambda x: x["etype"] == "import"), lambda x: x["e"]["stmt"]))
    import_rows = F.transform(
        _imports(F.col("events")),
        lambda i: F.struct(F.lit("import").alias("etype"), i["local"].alias("name"), i["module"].alias("module"),
                           i["is_from"].alias("is_from"), first_stmt.alias("stmt")),
    )
    has_import = F.exists("events", lambda x: x["etype"] == "import")
    event_type = lines.schema["events"].dataType.elementType["e"].dataType
    none = F.array().cast(T.ArrayType(T.StructType([
        T.StructField("etype", T.StringType()), T.StructField("e", event_type),
        T.StructField("i", T._parse_datatype_string(f"struct<{_IMPORT}>")),
        T.StructField("loop_line", T.LongType()), T.StructField("loop", T.LongType())])))
    no_event, no_name = F.lit(None).cast(event_type), F.lit(None).cast(f"struct<{_IMPORT}>")
    rows = (
        lines.where((F.size("events") > 0) | (F.size("nested") > 0) | F.col("wrong").isNotNull())
        .withColumns({
            "parens": F.when(F.exists("events", lambda x: x["etype"] == "paren"), _open_parens(F.col("events")))
            .otherwise(F.array().cast(f"array<{_PAREN}>")),
            "values": F.transform(F.filter("events", lambda x: x["etype"] == "value"), lambda x: x["e"]),
            "imports": F.when(has_import, import_rows).otherwise(F.array().cast(f"array<struct<{_IMPORT}>>")),
            "around": F.concat(F.transform("blocks", lambda b: b["lline"]), F.array("lline")),
        })
        .withColumn("x", F.explode(F.concat(
            F.transform(
                F.filter("events", lambda x: ~x["etype"].isin("import", "value", "paren", "iter")),
                lambda x: F.struct(x["etype"].alias("etype"), x["e"].alias("e"), no_name.alias("i"),
                                   F.lit(None).cast("bigint").alias("loop_line"), F.lit(None).cast("bigint").alias("loop"))),
            F.transform("imports", lambda i: F.struct(
                F.lit("import").alias("etype"), no_event.alias("e"), i.alias("i"),
                F.lit(None).cast("bigint").alias("loop_line"), F.lit(None).cast("bigint").alias("loop"))),
            F.transform("nested", lambda n: F.struct(
                F.lit("nested").alias("etype"), no_event.alias("e"), no_name.alias("i"),
                n["line"].alias("loop_line"), n["lline"].alias("loop"))),
            F.when(F.col("wrong").isNotNull(), F.array(F.struct(
                F.lit("bad").alias("etype"), no_event.alias("e"),
                F.struct(F.lit("bad").alias("etype"), F.col("wrong.why").alias("name"), F.lit("").alias("module"),
                         F.lit(False).alias("is_from"), F.lit(0).cast("bigint").alias("stmt")).alias("i"),
                F.col("wrong.line").cast("bigint").alias("loop_line"), F.col("lline").alias("loop")))).otherwise(none),
        )))
        .select("file_id", "lline", "is_spark", "loop_depth", "scopes", "around", "parens", "eline", "x.*",
                F.get(F.filter("values", lambda v: v["stmt"] == F.col("x.e.stmt")), F.lit(0)).alias("value"))
    )
    source = F.when(F.col("etype") == "bind", F.col("value")).otherwise(F.col("e"))
    rows = rows.withColumn("src", F.when(F.col("etype").isin("method", "call", "deco", "bind"), source)).withColumn(
        "inner", F.when(F.col("src.root") == "(", F.get(F.filter("parens", lambda p: p["at"] == F.col("src.root_pos")), F.lit(0)))
    )
    is_bind = F.col("etype") == "bind"
    root_kind = F.coalesce("inner.root_kind", "src.root_kind")
    end_kind = F.when((F.col("src.hops") == 0) & F.col("inner").isNotNull(), F.col("inner.end_kind")).otherwise(
        F.col("src.end_kind"))
    # a bare call or a bare decorator asks for its own name, anything else for the root of its chain
    asked = (
        F.when(_is("etype", "call", "concat") | ((F.col("etype") == "deco") & ~F.col("e.dotted")), F.col("e.name"))
        .when(root_kind == "name", F.coalesce("inner.root", "src.root"))
    )
    return rows.select(
        "file_id", "lline", "is_spark", "loop_depth", "scopes", "around", "etype",
        F.coalesce("e.pos", "loop", F.lit(-1)).alias("pos"), F.coalesce("e.stmt", "i.stmt").alias("stmt"),
        F.coalesce("e.name", "i.name").alias("name"), F.col("i.module").alias("module"), F.col("i.is_from").alias("is_from"),
        asked.alias("asked"),
        (F.coalesce("src.hops", F.lit(0)) + F.coalesce("inner.hops", F.lit(0))).alias("hops"),
        (is_bind & F.coalesce((root_kind == "str") & (end_kind == "str"), F.lit(False))).alias("is_string"),
        (is_bind & F.coalesce((F.col("src.tok") == ")") & (F.col("src.callee") == "open"), F.lit(False))).alias("is_open"),
        F.coalesce("e.line", "loop_line").alias("line"),
        F.when(F.col("etype") == "nested", F.col("eline"))
        .when(F.col("etype") == "bad", F.col("loop_line"))
        .when(F.col("etype") == "concat", F.col("value.eline"))
        .when((F.col("etype") == "deco") & ~F.col("e.called"), F.col("e.eline"))
        .otherwise(F.col("e.call_end")).alias("end_line"),
        F.col("e.dotted").alias("dotted"), "e.args.*",
    )


def names_per_file(rows: DataFrame) -> DataFrame:
    """Names as of their position: one row per file with its assignments, their tags and the uses to judge.

    Adds module / qualified (last import of the name before the use), tag (string, pandas, spark, file or ''
    from the last assignment visible in the enclosing scopes), as_param (a Spark session parameter is the latest
    meaning) and as_handle (inside the with block that opened it).
    """
    is_event = _is("etype", "bind", "param", "handle", "import")
    own_scope = F.element_at("scopes", -1)
    wants = ~_is("etype", "param", "handle", "import") & (
        (F.col("etype") != "bind") | F.col("asked").isNotNull() | F.col("is_string") | F.col("is_open")
    )
    imports_scope = F.lit(-2).cast("bigint")
    entry = lambda key, scope, event: F.struct(key.alias("key"), scope.alias("scope"), F.lit(event).alias("ev"))
    none = F.array().cast("array<struct<key:string,scope:bigint,ev:int>>")
    # assignments are numbered, so that a value finds the one it goes back to without a search
    wanted = F.coalesce((F.col("etype") == "bind") & wants, F.lit(False))
    ranks = F.row_number().over(Window.partitionBy("file_id", "wanted").orderBy("pos")) - 1
    ordered = rows.withColumn("wanted", wanted).withColumn("nth", F.when(F.col("wanted"), ranks)).drop("wanted")
    keyed = ordered.withColumn("k", F.explode(F.concat(
        F.when(is_event, F.array(entry(
            F.col("name"), F.when(F.col("etype") == "import", imports_scope).otherwise(own_scope), 1))).otherwise(none),
        F.when(wants, F.transform(
            F.when(F.col("asked").isNotNull(), F.concat(F.array(imports_scope), F.col("scopes")))
            .otherwise(F.array(imports_scope)),
            lambda sc: entry(F.coalesce("asked", F.lit("")), sc, 0))).otherwise(none),
    )))
    order = (
        Window.partitionBy("file_id", "key", "scope").orderBy("stmt", "ev", "pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def latest(kind: str, value: Column) -> Column:
        return F.last(F.when((F.col("ev") == 1) & (F.col("etype") == kind), value), True).over(order)

    payload = [c for c in rows.columns if c not in ("file_id", "pos", "etype", "scopes", "module", "is_from", "around")]
    seen = (
        keyed.select("*", "k.key", "k.scope", "k.ev").drop("k")
        .withColumns({
            "l_bind": latest("bind", F.struct("pos", "nth")),
            "l_param": latest("param", F.col("pos")),
            "l_handle": latest("handle", F.struct("pos", "lline")),
            "l_module": latest("import", F.col("module")),
            "l_from": latest("import", F.when(F.col("is_from"), F.col("module"))),
        })
        .where(F.col("ev") == 0)
        .groupBy("file_id", "pos", "etype")
        .agg(
            *[F.first(c).alias(c) for c in payload + ["around"] if c != "end_line"], F.max("end_line").alias("end_line"),
            F.max("l_bind").alias("l_bind"), F.max("l_param").alias("l_param"), F.max("l_handle").alias("l_handle"),
            F.max("l_module").alias("module"), F.max("l_from").alias("qualified"),
        )
    )
    is_bind = F.col("etype") == "bind"
    # an assignment clears its own name before its value is judged
    itself = is_bind & F.coalesce(F.col("asked") == F.col("name"), F.lit(False))
    near = F.col("asked").isNotNull() & (F.col("hops") <= F.when(is_bind, MAX_HOPS - 1).otherwise(MAX_HOPS))
    bind_at = F.when(~itself, F.col("l_bind.nth"))
    module, qualified = F.coalesce("module", F.lit("")), F.coalesce("qualified", F.lit(""))
    seen = (
        seen.withColumns({
            "bound_at": bind_at,
            "as_param": F.when(itself, F.lit(False)).otherwise(
                F.coalesce(F.col("l_param") > F.coalesce("l_bind.pos", F.lit(-1)), F.lit(False))),
            "as_handle": F.when(
                F.coalesce(F.col("l_handle.pos") > F.coalesce("l_bind.pos", F.lit(-1)), F.lit(False)),
                F.array_contains("around", F.col("l_handle.lline"))),
            "module": module, "qualified": qualified, "near": near,
        })
        .withColumns({
            "of_pandas": F.col("near") & ((F.col("module") == "pandas") | F.col("module").startswith("pandas.")),
            "of_spark": F.col("near") & (
                (F.col("asked") == "SparkSession") | F.contains("module", F.lit("pyspark"))
                | F.contains("qualified", F.lit("pyspark")) | F.col("as_param")),
        })
        .drop("around", "l_bind", "l_param", "l_handle")
    )
    bind_fields = F.struct("pos", "bound_at", "is_string", "is_open", "of_pandas", "of_spark", "near", "name", "line")
    use_cols = [c for c in seen.columns if c not in ("file_id", "is_string", "is_open")]
    per_file = (
        seen.groupBy("file_id")
        .agg(
            F.array_sort(F.collect_list(F.when(is_bind, bind_fields))).alias("binds"),
            F.collect_list(F.when(~is_bind, F.struct(*use_cols))).alias("uses"),
        )
    )

    # a value without a tag of its own has that of the assignment it goes back to, if that is of pandas or Spark. Each
    # assignment keeps what it gives for a table of pandas, one of Spark and anything else behind it; in every round it
    # takes over where the one behind it goes back to, so that a chain of n assignments is followed in log n rounds
    number = {tag: k for k, tag in enumerate(TAGS)}
    first = F.transform("binds", lambda b: F.struct(
        F.when(b["near"], b["bound_at"]).cast("int").alias("to"),
        *[F.when(b["is_string"], number["string"]).when(b["of_pandas"], number["pandas"]).otherwise(then).alias(name)
          for name, then in (("pandas", F.lit(number["pandas"])), ("spark", F.lit(number["spark"])), (
              "other", F.when(b["of_spark"], number["spark"]).when(b["is_open"], number["file"]).otherwise(number[""])))]))

    def follow(s: Column, behind: Column) -> Column:
        given = lambda tag: F.when(tag == number["pandas"], s["pandas"]).when(tag == number["spark"], s["spark"]).otherwise(s["other"])
        return F.when(behind.isNull(), s).otherwise(F.struct(
            behind["to"].alias("to"), *[given(behind[x]).alias(x) for x in ("pandas", "spark", "other")]))

    def jump(acc: Column, _: Column) -> Column:
        return F.when(F.exists(acc, lambda s: s["to"].isNotNull()), F.transform(
            acc, lambda s: X.let(F.get(acc, s["to"]), lambda behind: follow(s, behind)))).otherwise(acc)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("binds") + F.lit(1))).cast("int"))
    known = F.aggregate(rounds, first.cast("array<struct<to:int,pandas:int,spark:int,other:int>>"), jump)
    tags = F.transform(known, lambda s: F.get(F.array(*[F.lit(t) for t in TAGS]), s["other"]))
    return per_file.withColumn("tags", tags)


def tagged_bindings(names: DataFrame) -> DataFrame:
    """Assignments that give a name a tag: file_id, name, line, tag."""
    return (
        names.select("file_id", F.explode(F.arrays_zip("binds", "tags")).alias("b"))
        .select("file_id", "b.binds.name", F.col("b.binds.line").cast("int").alias("line"), F.col("b.tags").alias("tag"))
        .where(F.col("tag") != "")
    )


def resolved_uses(names: DataFrame) -> DataFrame:
    """The uses with the tag of the name they ask about."""
    return (
        names.where(F.size("uses") > 0).withColumn("u", F.explode("uses"))
        .select("file_id", "u.*", F.coalesce(
            F.get("tags", F.col("u.bound_at")), F.lit("")).alias("tag"))
        .withColumns({
            "pandas_rooted": F.col("of_pandas") | (F.col("near") & (F.col("tag") == "pandas")),
            "spark_rooted": F.col("of_spark") | (F.col("near") & (F.col("tag") == "spark")),
            "is_handle": F.coalesce("as_handle", F.col("tag") == "file"),
        })
    )
