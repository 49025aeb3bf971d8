"""Facts and rules on SQL texts: sql_units -> token rows -> hits.

sql_units: file_id, unit_no, dialect (sql | spark), start_line, sql. Every window is keyed by file_id first, so
the rows stay in the partitions of the files they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.functions import text as X
from codesift.operators import tokens as TK

# --- Fixed values -----------------------------------------------------------------------------
COMPARISONS = ["=", "==", "<>", "!=", ">", "<", ">=", "<=", "LIKE", "ILIKE"]
AGGREGATES = [
    "ANY_VALUE", "APPROX_COUNT_DISTINCT", "APPROX_DISTINCT", "APPROX_QUANTILE", "ARRAY_AGG", "ARRAY_CONCAT_AGG",
    "AVG", "BIT_AND", "BIT_OR", "BIT_XOR", "BOOL_AND", "BOOL_OR", "COLLECT_LIST", "COLLECT_SET", "CORR", "COUNT",
    "COUNT_IF", "COUNTIF", "COVAR_POP", "COVAR_SAMP", "EVERY", "FIRST", "FIRST_VALUE", "GROUP_CONCAT", "LAST",
    "LAST_VALUE", "LISTAGG", "MAX", "MAX_BY", "MEAN", "MEDIAN", "MIN", "MIN_BY", "MODE", "NTH_VALUE",
    "PERCENTILE", "PERCENTILE_APPROX", "PERCENTILE_CONT", "PERCENTILE_DISC", "SKEWNESS", "SOME", "STDDEV",
    "STDDEV_POP", "STDDEV_SAMP", "STRING_AGG", "SUM", "VAR_POP", "VAR_SAMP", "VARIANCE",
]
CLAUSES = [
    "SELECT", "FROM", "WHERE", "HAVING", "JOIN", "ON", "GROUP", "ORDER", "LIMIT", "FETCH", "QUALIFY", "SET",
    "VALUES", "WINDOW", "UNION", "EXCEPT", "INTERSECT", "MINUS",
]
FILTER_CLAUSES = ["WHERE", "HAVING", "ON"]
SET_OPERATORS = ["UNION", "EXCEPT", "INTERSECT", "MINUS"]
FUNCTION_KEYWORDS = ["LEFT", "RIGHT", "REPLACE"]  # names of functions where a bracket follows
OPERAND_ENDS = [
    "", "AND", "OR", ";", "GROUP", "ORDER", "LIMIT", "HAVING", "UNION", "EXCEPT", "INTERSECT", "JOIN", "LEFT", "RIGHT", "INNER",
    "FULL", "CROSS", "WHERE", "THEN", "ELSE", "END", "WHEN", "QUALIFY", "WINDOW", "ON", ",", "FETCH", "OFFSET", "NATURAL",
    "ESCAPE", "FOR", "AS",
]
ARITHMETIC = ["+", "-", "*", "/", "%", "||", "^", "&", "|", "::", "->", "->>", "COLLATE", "."]
# --- End of fixed values ----------------------------------------------------------------------

UNIT = ["file_id", "unit_no"]
UNREADABLE = "unreadable"

# Words of which a text with a hit has at least one.
TRIGGERS = {
    "sql.select_star": r"\*", "sql.leading_wildcard_like": "like", "sql.function_on_column": r"[(]|::|->|\bend\b",
    "sql.not_in_subquery": r"\bin\b", "sql.in_subquery": r"\bin\b", "sql.distinct": "distinct",
    "sql.order_without_limit": "order", "sql.correlated_subquery": r"select[\s\S]*?select", "sql.cross_join": "cross",
}


def lexed(sql: Column, dialect: Column) -> Column:
    """Token texts: those of the first reading that adds up.

    Readings in order: a backslash in a literal is a plain character, an escape, text between dollar marks is a literal, a
    hash opens a comment. Spark texts are read with escapes first. A reading is only made of texts that have its mark; a
    text that no reading fits keeps that with escapes. Comments behind a hash come back with two dashes.
    """

    def read(pattern: str) -> Column:
        return F.regexp_extract_all(sql, F.lit(pattern), F.lit(0))

    escapes, plain, dollar = read(TK.SQL_TOKEN), read(TK.SQL_TOKEN_PLAIN), read(TK.SQL_TOKEN_DOLLAR)
    body = lambda t: F.regexp_replace(t, TK.SQL_TRIVIA, "")
    hashed = F.transform(read(TK.SQL_TOKEN_HASH), lambda t: F.when(F.contains(t, F.lit("#")), F.concat(
        F.replace(F.regexp_extract(t, "(" + TK.SQL_TRIVIA_HASH + ")", 1), F.lit("#"), F.lit("--")),
        F.regexp_replace(t, TK.SQL_TRIVIA_HASH, ""))).otherwise(t))
    slashed, marked, hashes = (F.contains(sql, F.lit("\\")), sql.rlike(TK.SQL_DOLLAR), F.contains(sql, F.lit("#")))

    def adds_up(tokens: Column) -> Column:
        # computed once, else each hash of a text would make all its tokens anew
        return X.let(F.transform(tokens, body), fits)

    def fits(bodies: Column) -> Column:
        operand = r"^[\w\"'`$)\x{80}-\x{10FFFF}]"
        # a hash between two operands is an operator, any other one is left of a comment
        at = F.sequence(F.lit(0), F.size(bodies) - 1)
        astray = F.exists(at, lambda i: (F.get(bodies, i) == "#") & ~F.coalesce(
            F.get(bodies, i - 1).rlike(operand) & (F.get(bodies, i + 1).rlike(operand) | (F.get(bodies, i + 1) == "(")),
            F.lit(False)))
        return ~F.exists(bodies, lambda t: t.isin("'", '"', "`")) & ~(marked & F.exists(bodies, lambda t: t == "$")) & (
            F.size(F.filter(bodies, lambda t: t == "(")) == F.size(F.filter(bodies, lambda t: t == ")"))) & ~(hashes & astray)

    spark = dialect == "spark"
    return (
        F.when(~slashed & ~marked & ~hashes, escapes)
        .when(spark & adds_up(escapes), escapes).when(adds_up(plain), plain)
        .when(slashed & adds_up(escapes), escapes).when(marked & adds_up(dollar), dollar)
        .when(hashes & adds_up(hashed), hashed).otherwise(escapes)
    )


# --- Fixed values: what an operand can start behind, and what goes on with the operand before or behind it -----------
BEFORE_OPERANDS = [
    "", "(", ",", "=", "==", "<>", "!=", ">", "<", ">=", "<=", "<=>", "AND", "OR", "NOT", "WHERE", "ON", "HAVING", "WHEN",
    "THEN", "ELSE", "SELECT", "BY", "LIKE", "ILIKE", "BETWEEN", "QUALIFY",
]
JOINTS = [".", "::", "->", "->>"]
# --- End of fixed values ----------------------------------------------------------------------
_LOOSE_BRACKET = (
    r"(?i)(?:^|[^\w\s\"`\])]|\n|\b(?:AND|OR|NOT|WHERE|ON|HAVING|WHEN|THEN|ELSE|SELECT|BY|I?LIKE|BETWEEN|QUALIFY))\s*\(")
_FRAME = "struct<at:int,operands:int,loose:boolean,star:boolean>"
_FOLD = f"struct<open:array<{_FRAME}>,gone:array<int>,before:string>"


def _loose_brackets(words: Column) -> Column:
    """Places of the brackets around a single operand, of any number of such brackets around each other.

    One fold with a stack of open brackets: each counts the operands that start at its own level. CASE ... END is an
    operand, so it is a level of its own. A bracket behind a word is a call or a list and stays, as does one around *.
    """

    def frame(at: Column, loose: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(0).alias("operands"), loose.alias("loose"), F.lit(False).alias("star"))

    def step(acc: Column, x: Column) -> Column:
        word, top, below = x["word"], F.element_at(acc["open"], -1), F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1)
        opens, closes = (word == "(") | (word == "CASE"), (word == ")") | (word == "END")
        loose = (word == "(") & acc["before"].isin(BEFORE_OPERANDS)
        called = (word == "(") & ~loose & acc["before"].rlike(r"^[\w\"`\x{80}-\x{10FFFF}]")
        goes_on = called | word.isin(JOINTS) | acc["before"].isin(JOINTS)
        counted = F.struct(
            top["at"].alias("at"), (top["operands"] + F.when(goes_on, 0).otherwise(1)).alias("operands"),
            top["loose"].alias("loose"), (top["star"] | (word == "*")).alias("star"))
        around = top["loose"] & (word == ")") & (top["operands"] == 1) & ~top["star"]
        return F.struct(
            F.when(closes, F.when(F.size(below) > 0, below).otherwise(acc["open"]))
            .when(opens, F.concat(below, F.array(counted, frame(x["i"], loose)))).otherwise(F.concat(below, F.array(counted)))
            .alias("open"),
            F.when(closes & around, F.concat(acc["gone"], F.array(top["at"], x["i"]))).otherwise(acc["gone"]).alias("gone"),
            word.alias("before")).cast(_FOLD)

    start = F.struct(
        F.array(frame(F.lit(-1), F.lit(False))).alias("open"), F.array().cast("array<int>").alias("gone"),
        F.lit("").alias("before")).cast(_FOLD)
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("i")))
    return F.aggregate(placed, start, step, lambda acc: acc["gone"])


def without_loose_brackets(tokens: Column) -> Column:
    """Token texts without brackets around single operands; the blanks and comments before these go to the next token."""
    lead = lambda t: F.substring(t, F.lit(1), F.length(t) - 1)
    words = F.transform(tokens, lambda t: F.upper(F.regexp_replace(t, TK.SQL_TRIVIA, "")))

    def rest(gone: Column) -> Column:
        """Tokens that stay, each behind what stood before the brackets between it and the one before it."""
        kept = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: ~F.array_contains(gone, i))
        spans = X.let(kept, lambda k: F.transform(
            k, lambda i, n: F.struct(F.when(n > 0, F.get(k, n - 1)).otherwise(-1).alias("before"), i.alias("at"))))
        return F.transform(spans, lambda x: F.when(x["at"] == x["before"] + 1, F.get(tokens, x["at"])).otherwise(F.concat(
            F.array_join(F.transform(F.slice(tokens, x["before"] + 2, x["at"] - x["before"] - 1), lead), ""),
            F.get(tokens, x["at"]))))

    return X.let(_loose_brackets(words), lambda gone: F.when(F.size(gone) > 0, rest(gone)).otherwise(tokens))


def sql_tokens(units: DataFrame) -> DataFrame:
    """Significant tokens of SQL texts with line, bracket level, neighbours and statement number.

    u is the upper-cased word, ' for a string and '% for a string that starts with %. broken marks texts whose
    brackets or quotes do not add up.
    """
    order = Window.partitionBy(*UNIT).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*UNIT)
    tok, kind, u = F.col("tok"), F.col("kind"), F.col("u")
    first = F.substring("tok", 1, 1)
    word = first.between("a", "z") | first.between("A", "Z") | (first == "_") | (first >= "\u0080")
    upper = F.upper(tok)
    body = F.regexp_replace("raw", TK.SQL_TRIVIA, "")
    texts = F.col("texts")
    raw = (
        units.withColumn("texts", lexed(F.col("sql"), F.col("dialect"))).select(*UNIT, "dialect", "start_line",
                     F.posexplode(F.when(F.col("sql").rlike(_LOOSE_BRACKET), without_loose_brackets(texts)).otherwise(texts))
                     .alias("pos", "raw"))
        .withColumn("tok", F.when(F.substring("raw", 1, 1).isin(" ", "\n", "\t", "\f", "\r", "-", "/"), body)
                    .otherwise(F.col("raw")))
        .withColumn("kind", F.when(tok == "", "end")
                    .when((F.length(tok) == 1) & first.isin("'", '"', "`"), "bad")
                    .when((first == "'") | ((first == '"') & (F.col("dialect") == "spark")), "str")
                    .when((first == "$") & (F.length(tok) > 1), "str")
                    .when(first.isin('"', "`"), "ident")
                    .when(word & upper.isin(TK.SQL_KEYWORDS), "keyword")
                    .when(word, "ident")
                    .when(first.between("0", "9") | ((first == ".") & (F.length(tok) > 1)), "number")
                    .otherwise("op"))
        .withColumns({
            "u": F.when(kind == "str", F.when(tok.rlike(r"^(?:\$\w*\$|.)%"), "'%").otherwise("'")).otherwise(upper),
            "nl": F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit(""))),
            "tok_nl": F.length(tok) - F.length(F.replace(tok, F.lit("\n"), F.lit(""))),
            "step": F.when(tok == "(", 1).when(tok == ")", -1).otherwise(0),
        })
    )
    one = raw.withColumns({
        "eline": F.col("start_line") + F.sum("nl").over(upto),
        "depth": F.sum("step").over(upto),
        **{f"p{i}": F.lag("u", i).over(order) for i in (1, 2)},
        **{f"n{i}": F.lead("u", i).over(order) for i in (1, 2, 3)},
        "n1_kind": F.lead("kind", 1).over(order), "n2_kind": F.lead("kind", 2).over(order),
    }).withColumn(
        "kind", F.when((kind == "keyword") & u.isin(FUNCTION_KEYWORDS) & (F.col("n1") == "("), "ident").otherwise(kind)
    ).withColumns({
        "line": F.col("eline") - F.col("tok_nl"),
        "lvl": F.when(F.col("step") == 1, F.col("depth") - 1).otherwise(F.col("depth")),
        "is_column": (kind == "ident") & (F.coalesce("n1", F.lit("")) != "(") & (F.coalesce("p1", F.lit("")) != "AS"),
        "is_span": kind.isin("ident", "str", "number") | (tok == "*"),
        "ends": (tok == ";") & (F.col("depth") == 0),
    })
    return one.withColumns({
        "stmt": F.sum(F.col("ends").cast("int")).over(upto) - F.col("ends").cast("int"),
        "opens_stmt": F.col("p1").isNull() | F.lag("ends").over(order),
        "n_line": F.lead("line", 1).over(order), "nn_line": F.lead("line", 2).over(order),
        "n_eline": F.lead("eline", 1).over(order),
        "columns": F.sum(F.col("is_column").cast("int")).over(upto),
        "span_line": F.last(F.when(F.col("is_span"), F.col("eline")), True).over(upto),
        "wrong": F.min(F.when((kind == "bad") | (F.col("depth") < 0), F.col("pos"))).over(whole),
        "left_open": F.sum("step").over(whole),
    }).withColumns({
        "broken": F.col("wrong").isNotNull() | (F.col("left_open") != 0),
        # the place where an unreadable text shows it: the first wrong token, else its end
        "shows": F.coalesce(F.col("pos") == F.col("wrong"), (kind == "end") & (F.col("left_open") != 0)),
    }).drop("raw", "dialect", "start_line", "nl", "tok_nl", "step", "depth", "wrong", "left_open")


def bracket_groups(tokens: DataFrame) -> DataFrame:
    """Add the bracket group, clause and operand chain of each token.

    Brackets appear at their own level (role 0) and inside the group as its first (role 1) and last row (role 2);
    the first token of a statement is preceded by a group row of level 0 (role -1).
    """
    is_open, is_close = F.col("tok") == "(", F.col("tok") == ")"
    none = F.array().cast("array<int>")
    roles = F.concat(
        F.when(F.col("opens_stmt"), F.array(F.lit(-1))).otherwise(none),
        F.when(is_open, F.array(F.lit(0), F.lit(1))).when(is_close, F.array(F.lit(2), F.lit(0))).otherwise(
            F.array(F.lit(0))),
    )
    p1 = F.coalesce("p1", F.lit(""))
    goes_on = (
        (F.col("tok") == ".") | (p1 == ".")
        | (is_open & F.coalesce(F.col("p_kind") == "ident", F.lit(False))) | is_close
        | F.col("tok").isin(JOINTS) | p1.isin(JOINTS)
    )
    order0 = Window.partitionBy(*UNIT).orderBy("pos")
    rows = (
        tokens.withColumn("p_kind", F.lag("kind").over(order0))
        .withColumn("role", F.explode(roles))
        .withColumn("glvl", F.col("lvl") + F.when(F.col("role") > 0, 1).otherwise(0))
        .withColumn("begins", F.col("role").isin(-1, 1) | ((F.col("role") == 0) & ~goes_on))
    )
    order = Window.partitionBy(*UNIT, "glvl").orderBy("pos", F.when(F.col("role") == 2, -2).otherwise(F.col("role")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.col("role").isin(-1, 1)
    here = F.col("role") == 0
    text = F.when(here, F.col("u")).otherwise("")
    group = F.struct(
        F.when(F.col("role") == -1, -F.col("pos") - 1).otherwise(F.col("pos")).alias("id"),
        F.when(F.col("role") == -1, F.col("u")).otherwise(F.col("n1")).alias("opens_with"),
        F.when(F.col("role") == -1, "").otherwise(p1).alias("after"),
    )
    return (
        rows.withColumns({
            "group": F.last(F.when(mark, group), True).over(upto),
            "clause": F.last(F.when(mark, F.lit("")).when(here & F.col("u").isin(CLAUSES), F.col("u")), True).over(upto),
            "chain": F.last(F.when(F.col("begins"), F.struct(F.col("line"), p1.alias("before"))), True).over(upto),
            **{f"l{i}": F.lag(text, i).over(order) for i in (1, 2, 3, 4, 5)},
            "case": F.last(F.when(here & (F.col("u") == "CASE"), F.struct(
                "line", "columns", p1.alias("before"))), True).over(upto),
            "l3_cols": F.lag("columns", 3).over(order), "l4_kind": F.lag("kind", 4).over(order),
            "l4_line": F.lag("line", 4).over(order), "l2_eline": F.lag("eline", 2).over(order),
            **{f"r{i}": F.lead(text, i).over(order) for i in (1, 2, 3, 4)},
            "l1_cols": F.lag("columns", 1).over(order), "l2_cols": F.lag("columns", 2).over(order),
            "r2_cols": F.lead("columns", 2).over(order), "r3_cols": F.lead("columns", 3).over(order),
            "l3_kind": F.lag("kind", 3).over(order), "r1_kind": F.lead("kind", 1).over(order),
            "l3_line": F.lag("line", 3).over(order), "l1_eline": F.lag("eline", 1).over(order),
            "r1_line": F.lead("line", 1).over(order), "r3_eline": F.lead("eline", 3).over(order),
            "close_span": F.lead("span_line", 2).over(order),
        })
        .withColumns({"l1_chain": F.lag("chain", 1).over(order), "l2_chain": F.lag("chain", 2).over(order)})
    )


def _side_rules() -> Column:
    """(start, end) of a non-aggregate function over a column on the left, else on the right, of a comparison."""
    boundary = ["", "AND", "OR", "NOT", "WHERE", "ON", "HAVING", "WHEN", "THEN", "ELSE", "CASE", "BY", "SELECT", ","]
    after = OPERAND_ENDS
    fn = lambda name, kind: (kind == "ident") & ~name.isin(AGGREGATES) | (name == "CAST")
    # the operand on the left ends in front of the NOT of a NOT LIKE
    negated = F.col("u").isin("LIKE", "ILIKE") & (F.col("l1") == "NOT")
    at = lambda plain, after_not: F.when(negated, F.col(after_not)).otherwise(F.col(plain))
    l1, l2, l3, end = at("l1", "l2"), at("l2", "l3"), at("l3", "l4"), at("l1_eline", "l2_eline")
    columns = at("l1_cols", "l2_cols")
    l3_kind, l3_line = at("l3_kind", "l4_kind"), at("l3_line", "l4_line")
    left = (
        (l1 == ")") & (l2 == "(") & fn(l3, l3_kind) & F.coalesce(at("l4", "l5"), F.lit("")).isin(boundary)
        & (columns > at("l2_cols", "l3_cols"))
    )
    cast_left = l2 == "::"
    field_left = l2.isin("->", "->>") & (l3_kind == "ident")
    case_left = (l1 == "END") & (columns > F.col("case.columns"))
    right = (
        (F.col("r2") == "(") & (F.col("r3") == ")") & fn(F.col("r1"), F.col("r1_kind"))
        & F.coalesce("r4", F.lit("")).isin(after) & (F.col("r3_cols") > F.col("r2_cols"))
    )
    r1_named, r2, r4 = F.col("r1_kind") == "ident", F.col("r2"), F.coalesce("r4", F.lit(""))
    right = right | r1_named & (r2 == "::") & r4.isin(*after, "(") | r1_named & (r2 == ".") & (r4 == "::") | (
        r1_named & r2.isin("->", "->>") & r4.isin(after))
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return (
        F.when(F.coalesce(left | field_left, F.lit(False)), span(l3_line, end))
        .when(F.coalesce(cast_left, F.lit(False)), span(at("l1_chain.line", "l2_chain.line"), end))
        .when(F.coalesce(case_left, F.lit(False)), span(F.col("case.line"), end))
        .when(F.coalesce(right, F.lit(False)), span(F.col("r1_line"), F.coalesce("r3_eline", "r1_line")))
    )


def _case_on_the_right() -> Column:
    """(start, end) of a CASE over a column behind a comparison, given at its END; OPERAND_ENDS tells that no more follows."""
    return F.when(
        (F.col("u") == "END") & F.col("case.before").isin(COMPARISONS) & (F.col("columns") > F.col("case.columns"))
        & F.coalesce("r1", F.lit("")).isin(OPERAND_ENDS),
        F.struct(F.col("case.line").alias("start"), F.col("line").alias("end")))


def sql_rows(grouped: DataFrame) -> DataFrame:
    """The few rows the rules need: direct hits, clause words, group marks, predicates, references and aliases."""
    u, n1, n2, n3 = F.col("u"), *[F.coalesce(c, F.lit("")) for c in ("n1", "n2", "n3")]
    p1, p2 = F.coalesce("p1", F.lit("")), F.coalesce("p2", F.lit(""))
    here, word = F.col("role") == 0, F.col("kind") == "keyword"
    in_select = F.col("clause") == "SELECT"
    star = (
        here & (F.col("tok") == "*") & in_select
        & (p1.isin("SELECT", "DISTINCT", "ALL", ",", ".") | ((p2 == "TOP")))
        & (n1.isin("", ",", "FROM", ")", ";", "EXCEPT", "EXCLUDE", "REPLACE", "INTO", "WHERE", "UNION", "LIMIT", "ORDER")
           | (F.col("n1_kind") == "end"))
    )
    like = here & word & u.isin("LIKE", "ILIKE") & (
        ((n1 == "'%") & ~n2.isin(ARITHMETIC))
        | ((n1 == "(") & (n2 == "'%") & (n3 == ")")) | ((n1 == "(") & (n2 == "(") & (n3 == "'%"))
    )
    subquery = here & word & (u == "IN") & (n1 == "(") & (n2.isin("SELECT", "WITH") | ((n2 == "(") & (n3 == "SELECT")))
    negated = (F.col("l1") == "NOT") | (F.col("l1_chain.before") == "NOT")
    operand_line = F.when(F.col("l1") == "NOT", F.col("l2_chain.line")).otherwise(F.col("l1_chain.line"))
    span = lambda rule, a, b: F.struct(rule.alias("rule_id"), a.alias("start"), b.alias("end"))
    line = F.col("line")
    hit = (
        F.when(F.col("broken"), F.when(F.col("role") == 0, span(F.lit(UNREADABLE), line, line)))
        .when(star, span(F.lit("sql.select_star"), line, line))
        .when(like, span(F.lit("sql.leading_wildcard_like"), operand_line, F.col("n_eline")))
        .when(subquery & negated, span(F.lit("sql.not_in_subquery"), operand_line, F.col("close_span")))
        .when(subquery, span(F.lit("sql.in_subquery"), operand_line, F.col("close_span")))
        .when(here & word & (u == "SELECT") & (n1 == "DISTINCT"),
              span(F.lit("sql.distinct"), F.col("n_line"), F.col("n_line")))
        .when(here & word & (u == "CROSS") & (n1 == "JOIN"),
              span(F.lit("sql.cross_join"), F.col("nn_line"), F.col("nn_line")))
    )
    side = F.when(here & u.isin(COMPARISONS), _side_rules()).when(here, _case_on_the_right())
    name = F.upper(F.regexp_replace("tok", '^["`]|["`]$', ""))
    ident = here & (F.col("kind") == "ident")
    in_from = F.col("clause").isin("FROM", "JOIN")
    ref = ident & (n1 == ".") & ((F.col("n2_kind") == "ident") | (n2 == "*")) & ~n3.isin(".", "(") & ~in_from
    # a table that has another name is not known by its own; a name behind a table or a bracket is that other name
    p_kind = F.coalesce("p_kind", F.lit(""))
    renames = (p_kind == "ident") | p1.isin("AS", ")")
    renamed = ~renames & ((n1 == "AS") | ((F.col("n1_kind") == "ident") & (n2 != "(")))
    alias = ident & in_from & (n1 != ".") & ((n1 != "(") | renames) & ~F.coalesce(renamed, F.lit(False))
    cte = ident & (F.col("clause") == "") & p1.isin("WITH", "RECURSIVE", ",") & n1.isin("AS", "(")
    mark = F.col("role").isin(-1, 1)
    select_group = F.when(F.col("role") == -1, u.isin("SELECT", "WITH", "INSERT", "CREATE")).otherwise(
        n1.isin("SELECT", "WITH"))
    derived = (F.col("role") == -1) | p1.isin("FROM", "JOIN", "LATERAL", "AS")
    rtype = (
        F.when(mark, "mark").when(F.col("role") == 2, "close")
        .when(here & (F.col("kind") == "end"), "close").when(here & F.col("ends"), "close")
        .when(here & word & u.isin(CLAUSES + ["TOP"]), "clause")
        .when(here & (u.isin(COMPARISONS) | F.col("side").isNotNull()) & (F.col("clause") != "SET"), "pred").when(ref, "ref").when(alias, "alias")
        .when(cte, "cte")
    )
    flagged = grouped.withColumns({"hit": hit, "side": side}).withColumn("rtype", rtype)
    return flagged.where(F.col("rtype").isNotNull() | F.col("hit").isNotNull()).select(
        *UNIT, "pos", "role", "glvl", "stmt", "rtype", "u", "hit", "side", "line", "nn_line",
        F.col("n1").alias("next"), F.col("group.id").alias("group_id"),
        F.col("group.opens_with").alias("opens_with"), name.alias("name"),
        select_group.alias("select_group"), derived.alias("derived"), (p1 == "LATERAL").alias("lateral"), "span_line",
        F.when(F.col("role") == 1, F.col("nn_line")).alias("first_line"),
        F.lag("span_line").over(Window.partitionBy(*UNIT, "glvl").orderBy("pos", "role")).alias("p_span"),
    )


#: Rules that a token and its neighbours in the same brackets decide: they need no query around them.
LOCAL_RULES = [
    "sql.select_star", "sql.leading_wildcard_like", "sql.not_in_subquery", "sql.in_subquery", "sql.distinct", "sql.cross_join",
]


def sql_hits(units: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Raw hits of the nine SQL rules, or of some: file_id, unit_no, rule_id, start_line, end_line, pos.

    A text that no reading fits gives one row of the rule `unreadable` at the place where that shows.
    """
    tokens = sql_tokens(units)
    rows = sql_rows(bracket_groups(tokens.where(~F.col("broken") | F.col("shows"))))
    if rules is None or not set(rules) <= set(LOCAL_RULES):
        return rule_hits(rows)
    return rows.where(F.col("hit").isNotNull()).select(
        *UNIT, "hit.rule_id", F.col("hit.start").cast("int").alias("start_line"),
        F.greatest(F.col("hit.start"), F.coalesce("hit.end", "hit.start")).cast("int").alias("end_line"), "pos")


def token_context(rows: DataFrame) -> DataFrame:
    """One row per kept token with the bracket levels around it (inside out) and whether it is in a filter."""
    in_group = Window.partitionBy(*UNIT, "glvl", "group_id")
    ordered = in_group.orderBy("pos", "role")
    clause = F.col("rtype") == "clause"
    sorts = clause & (F.col("u") == "ORDER") & (F.col("next") == "BY")
    unlimited = rows.withColumns({
        "limited": F.max(clause & F.col("u").isin("LIMIT", "FETCH", "TOP")).over(in_group),
        "combined": F.max(clause & F.col("u").isin(SET_OPERATORS)).over(in_group),
        "selects": F.max(clause & (F.col("u") == "SELECT")).over(in_group),
        "stop": F.lead(F.when(F.col("rtype").isin("clause", "close"), F.col("span_line"))).over(
            ordered),
    })
    order_hit = F.when(
        sorts & ~F.col("limited") & ~F.col("combined") & F.col("selects"),
        F.struct(F.lit("sql.order_without_limit").alias("rule_id"), F.col("nn_line").alias("start"),
                 F.greatest(F.col("nn_line"), F.coalesce("stop", "nn_line")).alias("end")),
    )
    # predicates and references look through every bracket level around them
    inside = F.col("rtype").isin("pred", "ref")
    group = F.struct(F.col("group_id").alias("id"), "select_group", "derived", "lateral", F.col("first_line").alias("start"))
    levels = F.when(inside, F.sequence(F.lit(0).cast("bigint"), F.col("glvl"))).otherwise(F.array("glvl"))
    by_level = Window.partitionBy(*UNIT, "at").orderBy("pos", F.when(F.col("role") == 2, -2).otherwise(F.col("role")))
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_mark = F.col("rtype") == "mark"
    at_level = (
        unlimited.withColumn("hit", F.coalesce("hit", order_hit))
        .withColumn("at", F.explode(levels))
        .withColumns({
            "in_clause": F.last(F.when(is_mark, F.lit("")).when(clause & F.col("u").isin(CLAUSES), F.col("u")),
                                True).over(upto),
            "in_group": F.last(F.when(is_mark, group), True).over(upto),
            "in_merge": F.last(F.when(is_mark, F.col("opens_with") == "MERGE"), True).over(upto),
        })
    )
    # one row per token again, with the groups around it from the inside out
    around = F.struct((-F.col("at")).alias("depth"), "in_clause", "in_group", "in_merge")
    per_token = (
        at_level.groupBy(*UNIT, "pos", "role")
        .agg(
            *[F.first(c).alias(c) for c in ("rtype", "hit", "side", "u", "name", "group_id", "line", "span_line")],
            F.array_sort(F.collect_list(F.when(inside, around))).alias("around"),
        )
        .where(F.col("rtype").isNull() | ~F.col("rtype").isin("mark", "clause") | F.col("hit").isNotNull())
    )
    context = F.get(F.filter("around", lambda a: a["in_clause"] != ""), F.lit(0))
    in_filter = context["in_clause"].isin(FILTER_CLAUSES) & ~((context["in_clause"] == "ON") & context["in_merge"])
    return per_token.withColumn("in_filter", F.coalesce(in_filter, F.lit(False)))


def clause_context(units: DataFrame) -> DataFrame:
    """Every comparison with whether it stands in a WHERE, HAVING or join condition."""
    tokens = sql_tokens(units).where(~F.col("broken"))
    context = token_context(sql_rows(bracket_groups(tokens)))
    return context.where((F.col("rtype") == "pred") & (F.col("u") != "END")).select(
        *UNIT, F.col("line").cast("int").alias("line"), F.col("u").alias("op"), "in_filter")


def rule_hits(rows: DataFrame) -> DataFrame:
    """Finish the rules that need an enclosing group: filters, sorting without a limit, correlation."""
    per_token = token_context(rows)
    # a query in FROM is a table, whatever stands before its bracket
    tables = F.transform("around", lambda a, i: F.struct(
        a["depth"].alias("depth"), a["in_group"].alias("in_group"),
        (a["in_group"]["derived"] | F.coalesce(F.get("around", i + 1)["in_clause"].isin("FROM", "JOIN"), F.lit(False)))
        .alias("derived")))
    scopes = F.filter(tables, lambda a: a["in_group"]["select_group"])
    # rows per (group, name): aliases and the references that may resolve to them
    none = F.array().cast("array<struct<gid:int,depth:bigint>>")
    lookups = F.when(
        F.col("rtype") == "ref",
        F.transform(scopes, lambda a: F.struct(a["in_group"]["id"].alias("gid"), a["depth"].alias("depth")))
    ).when(F.col("rtype").isin("alias", "cte"), F.array(F.struct(F.col("group_id").alias("gid"), F.lit(0).cast("bigint").alias("depth")))
           ).otherwise(none)
    named = (
        per_token.withColumns({
            # beside the hit of the same token: a LIKE may have a function on its left and a wildcard on its right
            "wrapped": F.when(
                (F.col("rtype") == "pred") & F.col("side").isNotNull() & F.col("in_filter"),
                F.struct(F.lit("sql.function_on_column").alias("rule_id"), F.col("side.start").alias("start"),
                         F.col("side.end").alias("end")),
            ),
            "scopes": F.when(F.col("rtype") == "ref", scopes),
            "lookup": F.explode_outer(lookups),
        })
        .withColumns({rtype: F.max(F.col("rtype") == rtype).over(
            Window.partitionBy(*UNIT, "lookup.gid", F.when(F.col("lookup").isNotNull(), F.col("name"))))
            for rtype in ("alias", "cte")})
    )
    resolved = (
        named.groupBy(*UNIT, "pos", "role")
        .agg(
            F.first("rtype").alias("rtype"), F.first("hit").alias("hit"), F.first("wrapped").alias("wrapped"),
            F.first("scopes").alias("scopes"),
            F.min(F.when((F.col("rtype") == "ref") & F.col("alias"), F.col("lookup.depth"))).alias("found"),
            F.max((F.col("rtype") == "ref") & F.col("cte")).alias("of_cte"),
            F.first("span_line").alias("span_line"), F.first("group_id").alias("group_id"),
        )
    )
    # a name that its own query does not have comes from outside, be its owner known or not: every subquery up to the
    # owner is correlated, as far as no query that is a table is in between; names of WITH are known everywhere inside.
    # the outermost query is none's subquery
    beyond = F.lit(1 << 40)
    stop = F.array_min(F.transform(
        F.filter("scopes", lambda a: a["derived"] & ~a["in_group"]["lateral"]), lambda a: a["depth"]))
    crossed = F.when(
        (F.col("rtype") == "ref") & ~F.col("of_cte"),
        F.filter(F.slice("scopes", F.lit(1), F.size("scopes") - 1),
                 lambda a: (a["depth"] < F.least(F.coalesce("found", beyond), F.coalesce(stop, beyond))) & ~a["derived"]),
    )
    ends = F.when(F.col("rtype") == "close", F.array(F.struct(
        F.col("group_id").alias("gid"), F.lit(None).cast("bigint").alias("start"), F.col("span_line").cast("bigint").alias("end"))))
    starts = F.transform(crossed, lambda a: F.struct(
        a["in_group"]["id"].alias("gid"), a["in_group"]["start"].cast("bigint").alias("start"),
        F.lit(None).cast("bigint").alias("end")))
    correlated = F.coalesce(starts, ends)
    out = resolved.where(F.col("hit").isNotNull() | F.col("wrapped").isNotNull() | (F.size(F.coalesce(starts, F.array())) > 0) | ends.isNotNull())
    pieces = out.select(*UNIT, "pos", "hit", "wrapped", F.explode_outer(correlated).alias("c"))
    per_group = Window.partitionBy(*UNIT, "c.gid")
    spanned = pieces.withColumns({
        "c_start": F.min("c.start").over(per_group), "c_end": F.max("c.end").over(per_group),
        "nth": F.row_number().over(per_group.orderBy(F.col("c.start").isNull(), "pos")),
    })
    c_hit = F.when(
        F.col("c.start").isNotNull() & (F.col("nth") == 1),
        F.struct(F.lit("sql.correlated_subquery").alias("rule_id"), F.col("c_start").alias("start"),
                 F.greatest("c_start", "c_end").alias("end")),
    )
    return (
        spanned.select(*UNIT, "pos", F.explode(F.array_compact(F.array(
            *[F.when(F.col(h).isNotNull(), F.struct(
                F.col(f"{h}.rule_id").alias("rule_id"), F.col(f"{h}.start").cast("bigint").alias("start"),
                F.col(f"{h}.end").cast("bigint").alias("end"))) for h in ("hit", "wrapped")],
            c_hit))).alias("h"))
        .select(*UNIT, "h.rule_id", F.col("h.start").cast("int").alias("start_line"),
                F.greatest(F.col("h.start"), F.coalesce("h.end", "h.start")).cast("int").alias("end_line"), "pos")
    )
