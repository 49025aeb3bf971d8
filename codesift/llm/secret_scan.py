"""Secret scan: three fixed patterns and sliding-window entropy, in built-in functions only.

Spans are (kind, start, end) in code points, end exclusive. The matches of a pattern and the texts between them, from one
split, give all places of a text by a running sum; nothing is searched twice and no text is moved.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The patterns of the three base kinds.
ASSIGN = (
    "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs are maximal, so shorter ones need not be found and dropped

#: Parts of candidates that are no secrets: placeholders, counting sequences, digests of files with their names, one
#: character over and over.
ALLOWED = (
    r"(?i:example|sample|placeholder|changeme|dummy|xxxx|0123456789|1234567890|abcdefgh)"
    r"|^sha(?:256|384|512)-[A-Za-z0-9+/]+=*|(.)\1{5}"
)
#: Words in names, paths and addresses: behind a separator, or long ones. Of 24 random letters of both cases, digits and
#: signs about one in twenty holds one.
WORDS = "[/_-][A-Z]?[a-z]{3,}|[A-Z]?[a-z]{7,}"


@dataclass(frozen=True)
class EntropyClass:
    """Maximal runs of the characters, cut at all matches of allowed; of the parts that hold each of needs, windows with
    bits or more of entropy are reported, from the first such window of a run to its last one."""

    kind: str
    characters: str
    needs: tuple[str, ...]
    window: int
    bits: float
    allowed: str = ALLOWED


CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", ("[0-9]", "[A-F]"), 24, 3.0),
    EntropyClass("entropy_mixed", "A-Za-z0-9+/_=-", ("[0-9]", "[A-Z]", "[a-z]", "[^0-9A-Fa-f]"), 24, 3.9, f"{ALLOWED}|{WORDS}"),
    EntropyClass("entropy_lower", "0-9a-z", ("[0-9]", "[g-z]"), 24, 3.6),
    EntropyClass("entropy_upper", "0-9A-Z", ("[0-9]", "[G-Z]"), 24, 3.5),
)
#: Windows that are counted from one string: finding a place in a string takes time with the place, so long parts are cut
#: twice, each piece long enough for its last window.
_PIECE, _BLOCK = 16_384, 256
BASE_KINDS = ("assign", "access", "hex")
#: Count times its binary logarithm is held as a whole number of millionths: added and taken away without drift.
UNIT = 1_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running_sums(numbers: Column, block: int = 512) -> Column:
    """Running sums of an array, in blocks: appending to one array would take time in the square of its length."""

    def grow(values: Column, add: Callable[[Column], Column]) -> Column:
        return F.aggregate(
            values, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + add(x)))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")),
        lambda b: F.slice(numbers, b * block + 1, block))
    return _let(
        F.transform(blocks, lambda x: grow(x, lambda v: v)),
        lambda sums: _let(
            grow(sums, lambda x: F.element_at(x, -1)),
            lambda before: F.flatten(F.transform(
                sums, lambda x, b: F.transform(F.slice(x, 2, block), lambda v: v + F.get(before, b))))))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start: bigint, word: string>> of all leftmost matches; empty where there is none."""
    found = _let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")),
        lambda x: _let(
            _running_sums(F.transform(
                x["m"],
                lambda m, k: (F.length(F.get(x["gap"], k))
                              + F.when(k > 0, F.length(F.get(x["m"], k - 1))).otherwise(0)).cast("long"))),
            lambda starts: F.transform(
                x["m"], lambda m, k: F.struct(F.get(starts, k).alias("start"), m.alias("word")))))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(
        F.array().cast("array<struct<start:bigint,word:string>>"))


def _spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(order).alias("place"), F.lit(kind).alias("kind"),
        (m["start"] + F.length(m["word"])).alias("end")))


def _hot(word: Column, kind: EntropyClass) -> Column:
    """struct<first, last>: starts of the first and the last window of the word with enough entropy, or nulls.

    From one window to the next the sum of count * log2(count) changes by the step of the character that enters and the
    step of the one that leaves; both counts are taken in the characters the two windows share.
    """
    w = kind.window
    weight = [0] + [round(c * math.log2(c) * UNIT) for c in range(1, w + 1)]
    steps = F.array(*[F.lit(b - a) for a, b in zip(weight, weight[1:], strict=False)])
    most = math.floor((math.log2(w) - kind.bits) * w * UNIT)

    def step(acc: Column, i: Column) -> Column:
        shared = F.when(i <= w, F.substring(word, F.lit(1), i - 1)).otherwise(F.substring(word, i - w + 1, F.lit(w - 1)))

        def change(place: Column) -> Column:
            one = F.substring(word, place, F.lit(1))
            return F.get(steps, F.length(shared) - F.length(F.replace(shared, one, F.lit(""))))

        total = acc["total"] + change(i) - F.when(i > w, change(i - w)).otherwise(0)
        return _let(total, lambda t: F.struct(
            t.cast("int").alias("total"),
            F.when((i >= w) & (t <= most), F.coalesce(acc["first"], i - w)).otherwise(acc["first"]).alias("first"),
            F.when((i >= w) & (t <= most), i - w).otherwise(acc["last"]).alias("last")))

    start = F.struct(
        F.lit(0).alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)


def _cut(word: Column, window: int, size: int) -> Column:
    """array<struct<at, piece>>: pieces of the word with size windows each, the last with what is left."""
    return F.transform(
        F.sequence(F.lit(0), F.length(word) - window, F.lit(size)),
        lambda at: F.struct(at.alias("at"), F.substring(word, at + 1, F.lit(size + window - 1)).alias("piece")))


def _wanted(word: Column, kind: EntropyClass) -> Column:
    keep = F.lit(True)
    for need in kind.needs:
        keep = keep & F.rlike(word, F.lit(need))
    return keep


def _pieces(word: Column, kind: EntropyClass) -> Column:
    """array<struct<at, piece>>: the parts of a run between allowed matches, in pieces of bounded length."""

    def parts(found: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda m: (m["start"] + F.length(m["word"])).cast("int")))
        ends = F.concat(F.transform(found, lambda m: m["start"].cast("int")), F.array(F.length(word)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), F.substring(word, a + 1, b - a).alias("piece")))

    def finer(pieces: Column, size: int) -> Column:
        return F.flatten(F.transform(pieces, lambda x: F.transform(
            _cut(x["piece"], kind.window, size),
            lambda y: F.struct((x["at"] + y["at"]).alias("at"), y["piece"].alias("piece")))))

    whole = F.array(F.struct(F.lit(0).alias("at"), word.alias("piece")))
    cut = F.when(F.rlike(word, F.lit(kind.allowed)), _let(_matches(word, kind.allowed), parts)).otherwise(whole)
    kept = F.filter(cut, lambda x: (F.length(x["piece"]) >= kind.window) & _wanted(x["piece"], kind))
    return finer(finer(kept, _PIECE), _BLOCK)


def _hull(word: Column, kind: EntropyClass) -> Column:
    """struct<first, last>: starts of the first and the last hot window of a run, or nulls.

    Pieces are looked at from the front up to the first with a hot window, then from the back up to the last such one.
    """

    def ways(pieces: Column) -> Column:
        way = lambda back: lambda x: F.struct(x["at"].alias("at"), x["piece"].alias("piece"), F.lit(back).alias("back"))
        back = F.when(F.size(pieces) > 1, F.reverse(pieces)).otherwise(F.slice(pieces, 1, 0))
        return F.concat(F.transform(pieces, way(False)), F.transform(back, way(True)))

    def step(acc: Column, x: Column) -> Column:
        needed = F.when(x["back"], acc["first"].isNotNull() & ~acc["done"]).otherwise(acc["first"].isNull())
        return _let(F.when(needed, _hot(x["piece"], kind)), lambda hot: F.struct(
            F.coalesce(acc["first"], x["at"] + hot["first"]).alias("first"),
            F.coalesce(x["at"] + hot["last"], acc["last"]).alias("last"),
            (acc["done"] | (x["back"] & hot["last"].isNotNull())).alias("done")))

    none = F.lit(None).cast("int")
    start = F.struct(none.alias("first"), none.alias("last"), F.lit(False).alias("done"))
    return F.aggregate(_let(_pieces(word, kind), ways), start, step)


def _entropy_spans(text: Column, kind: EntropyClass, order: int) -> Column:
    runs = F.filter(_matches(text, f"[{kind.characters}]{{{kind.window},}}"), lambda m: _wanted(m["word"], kind))
    spans = F.transform(runs, lambda m: _let(_hull(m["word"], kind), lambda hot: F.struct(
        (m["start"] + hot["first"]).alias("start"), F.lit(order).alias("place"), F.lit(kind.kind).alias("kind"),
        (m["start"] + hot["last"] + kind.window).alias("end"))))
    return F.filter(spans, lambda s: s["start"].isNotNull())


def scan(docs: DataFrame, text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """row (struct of all columns of docs), base and spans: array<struct<start, place, kind, end>> by start and kind.

    base has the spans of the three patterns, spans those and the entropy spans. Null and empty texts have none. Each row
    gives one row, repeated rows each their own; an empty table stays empty; row keeps names of docs from clashing with
    those of the result. Texts of any length are scanned whole, in time in proportion to their length. Spans of different
    kinds may overlap; base spans are never suppressed.
    """
    t = F.col("t")
    assign = F.filter(
        _matches(t, ASSIGN), lambda m: F.length(F.regexp_extract(m["word"], ASSIGN, 2)) >= 6)
    access = F.when(F.contains(t, F.lit("AKIA")), F.filter(
        _matches(t, ACCESS), lambda m: F.length(m["word"]) >= 20)).otherwise(
        F.array().cast("array<struct<start:bigint,word:string>>"))
    base = F.concat(*[
        _spans(found, kind, k) for k, (kind, found) in enumerate(zip(BASE_KINDS, (assign, access, _matches(t, HEX)), strict=True))])
    more = [_entropy_spans(t, kind, len(BASE_KINDS) + k) for k, kind in enumerate(classes)]
    return (
        docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        .select("row", F.sort_array(base).alias("base"), F.concat(F.array().cast(
            "array<struct<start:bigint,place:int,kind:string,end:bigint>>"), *more).alias("more"))
        .select("row", "base", F.sort_array(F.concat("base", "more")).alias("spans"))
    )


def written(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_spans(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _masked(text: Column, spans: Column, mark: str, block: int = 65_536) -> Column:
    """The text with mark in place of each group of overlapping or touching spans.

    It is rebuilt block by block, as the place of a code point is found by counting from the start of its string.
    """
    longs = "struct<at:bigint,reach:bigint,out:string>"

    def rebuilt(b: Column) -> Column:
        low = b * block

        def one(piece: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                kept = F.when(s["start"] > acc["at"], F.substring(
                    piece, (acc["at"] - low + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).otherwise("")
                sign = F.when((s["start"] > acc["reach"]) & (s["start"] >= low), F.lit(mark)).otherwise("")
                return F.struct(
                    F.greatest(acc["at"], F.least(s["end"], low + block)).alias("at"),
                    F.greatest(acc["reach"], s["end"]).alias("reach"),
                    F.concat(acc["out"], kept, sign).alias("out"))

            start = F.struct(low.alias("at"), F.lit(-1).cast("long").alias("reach"), F.lit("").alias("out")).cast(longs)
            near = F.filter(spans, lambda s: (s["end"] >= low) & (s["start"] < low + block))
            return F.aggregate(near, start, step, lambda acc: F.concat(
                acc["out"], F.substring(piece, (acc["at"] - low + 1).cast("int"), (low + block - acc["at"]).cast("int"))))

        return _let(F.substring(text, (low + 1).cast("int"), F.lit(block)), one)

    blocks = F.sequence(F.lit(0).cast("long"), F.floor(F.length(text) / block).cast("long"))
    return F.array_join(F.transform(blocks, rebuilt), "")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]",
             classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """docs with the spans of scan() replaced by mark; all else, null texts and the order of columns stay as they are.

    Overlapping and touching spans are replaced by one mark.
    """
    new = F.when(F.size("spans") > 0, _masked(F.col("row")[text], F.col("spans"), mark)).otherwise(F.col("row")[text])
    return scan(docs, text, classes).select(F.col("row").withField(text, new).alias("row")).select("row.*")
