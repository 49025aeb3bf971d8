"""SimHash near-duplicates: fingerprints, and links between those that differ in few bits, found by Golay decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm import graph, rows

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Shingles that are hashed at once; bounds the memory of very long texts.
_STEP = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Signed 64-bit fingerprint. Words are split at blanks and A-Z lower-cased; without words it is 0.

    A bit is set where over half of the hashes of the shingles, repeats included, have it set; fewer words than width are
    one shingle.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, _STEP):
        part = words[at:at + _STEP + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """row (struct of all columns of docs) and f (bigint); a null text has no words."""

    def start() -> Callable[[list[bytes]], list[list]]:
        return lambda batch: [[fingerprint(x, width) for x in batch]]

    return rows.map_texts(docs, text, start, [T.StructField("f", T.LongType())])


# The binary Golay code: 12 bits of data above 11 check bits. Each 23-bit word is within 3 bits of one code word.
_GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (exact segment, decoded segment): with two differing bits or fewer, one of these pairs has none in the first segment
#: and one or fewer in the second. If two segments differ, the third is exact and the one that follows it differs in one
#: bit; if only one differs, the other two follow each other.
PAIRS = ((0, 1), (1, 2), (2, 0))


def _checks(word: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, _GENERATOR << (bit - 11), 0)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the error of up to 3 bits, and what to xor with the decoded index for all code words within 4 bits.

    An error of 3 bits has five code words of weight 7 around it, each 4 bits away; other words have none but their own.
    """
    data = np.arange(4096) << 11
    code = data | _checks(data)
    heavy = code[np.bitwise_count(code) == 7]
    patterns = np.array([sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(23), k)])
    error, near = np.zeros(2048, np.int64), np.zeros((2048, 6), np.int64)
    left = _checks(patterns)
    error[left] = patterns
    for pattern, check in zip(patterns, left, strict=True):
        if int(pattern).bit_count() == 3:
            near[check, 1:] = heavy[heavy & pattern == pattern] >> 11
    return error, near


def keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in f, key, whether the key is that of the nearest code word) for all keys of signed 64-bit fingerprints.

    If x and y differ in one bit or none of a segment, the code word nearest to x is within 4 bits of y, so it is among
    the keys of y: a pair within two bits meets in a key that is x's own.
    """
    error, near = _tables()
    parts = [(f.view(np.uint64) >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    at, out, own = [], [], []
    for number, (exact, fuzzy) in enumerate(PAIRS):
        check = _checks(parts[fuzzy])
        index = (parts[fuzzy] ^ error[check]) >> 11
        for k in range(6):
            has = np.flatnonzero((near[check, k] != 0) | (k == 0))
            at.append(has)
            out.append(number << 34 | parts[exact][has] << 12 | index[has] ^ near[check[has], k])
            own.append(np.full(len(has), k == 0))
    return np.concatenate(at), np.concatenate(out), np.concatenate(own)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows.pieces(batches, 1 << 14):
        f = batch.column("f").to_numpy(zero_copy_only=False)
        at, key, own = keys(f)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[at]), pa.array(own)], names=["key", "f", "own"])


class _Forest:
    """Links of one task: only the least node of each of its groups is kept for every node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.up.setdefault(min(x, y), min(x, y))


def _linked(own: np.ndarray, other: np.ndarray, forest: _Forest, bits: int, step: int = 512) -> None:
    """Links each fingerprint of own to those of other within bits; all are compared, in steps of bounded memory."""
    for k in range(0, len(own), step):
        part = own[k:k + step]
        a, b = np.nonzero(np.bitwise_count((part[:, None] ^ other[None, :]).view(np.uint64)) <= bits)
        for x, y in zip(part[a].tolist(), other[b].tolist(), strict=True):
            if x != y:
                forest.link(x, y)


#: Rows of a bucket that one task compares with another such part; larger buckets are dealt out as pairs of parts.
PART = 4096


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """a, b: links that join the same fingerprints (f, distinct) as all pairs within bits (2 at most) do.

    Rows of a key meet in one task, which compares them all and gives a spanning forest of what it has seen, so that
    dense groups of near copies don't grow into pairs. A bucket of more than PART rows is cut into parts by hash, and
    every pair of parts, each with itself too, becomes a task of its own: nothing is left out at any size.
    """
    keyed = rows.checkpointed(rows.map_arrow(distinct.select("f"), _keyed, "key long, f long, own boolean"))
    large = keyed.groupBy("key").count().filter(F.col("count") > PART).select(
        F.col("key").alias("k"), F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    dealt = keyed.join(large, F.col("key") == F.col("k"), "left").withColumn(
        "part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")).otherwise(0))
    other = F.explode(F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array(F.lit(0))))
    pairs = dealt.select("key", "f", "own", "part", other.alias("o")).select(
        "key", "f", "own", "part", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, group = _Forest(), [], None

        def flush(held: list) -> None:
            f, own, part = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(f) < 2:
                return
            parts = np.unique(part)
            if len(parts) == 1:
                _linked(f[own], f, forest, bits)
            else:
                one = part == parts[0]
                _linked(f[own & one], f[~one], forest, bits)
                _linked(f[own & ~one], f[one], forest, bits)

        for batch in batches:
            key, p, q, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "p", "q", "part"))
            f = batch.column("f").to_numpy(zero_copy_only=False)
            own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                now = (key[a], p[a], q[a])
                if now != group:
                    if held:
                        flush(held)
                    held, group = [], now
                if b - a > 1 or held or b == len(key):
                    held.append((f[a:b], own[a:b], part[a:b]))
        if held:
            flush(held)
        found = [(r, x) for x in forest.up if (r := forest.root(x)) != x]
        for k in range(0, len(found), 1 << 14):
            a, b = zip(*found[k:k + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = pairs.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return rows.map_arrow(met, compare, "a long, b long")


def components(prints: DataFrame, bits: int = 2) -> DataFrame:
    """f, root: the least fingerprint that each fingerprint of prints (f; repeats allowed) reaches over its links."""
    distinct = prints.select("f").distinct()
    found = graph.components(links(distinct, bits))
    return distinct.join(found, F.col("f") == F.col("node"), "left").select("f", F.coalesce("root", "f").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, f, component_id (the smallest doc_id that the document reaches over links, its own included).

    Every row gives one row. Texts without words, null ones included, have fingerprint 0 and link like any other. Rows
    with a null id take part; their own component_id is the smallest id that is not null, null if there is none.
    """
    prints = rows.checkpointed(fingerprints(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), "t").select(
        F.col("row.d").alias("doc_id"), "f"))
    by_print = prints.groupBy("f").agg(F.min("doc_id").alias("least"))
    rooted = rows.checkpointed(by_print.join(components(by_print), "f"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("f", "component_id"), "f").select("doc_id", "f", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked rows, with all columns of docs: the one with the smallest id (null ids last).

    Of rows that share that id one stays. The documents are written once with their fingerprints; that table's files and
    row numbers are the identity of rows, so that nothing depends on ids being distinct.
    """
    place = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")]
    prints = rows.landed(fingerprints(docs, text)).select("row", "f", *place)
    by_print = prints.select(F.col("row")[doc_id].alias("i"), "f", "file", "at").groupBy("f").agg(
        F.min(F.struct(F.col("i").isNull().alias("none"), "i", "file", "at")).alias("first"))
    best = by_print.join(components(by_print), "f").groupBy("root").agg(F.min("first").alias("first")).select(
        "first.file", "first.at")
    return prints.join(best, ["file", "at"], "left_semi").select("row.*")
