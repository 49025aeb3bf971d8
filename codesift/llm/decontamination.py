"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in whole documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm import rows

#: A-Z to a-z; bytes that are in no word to blanks. Bytes of characters beyond ASCII are in words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

#: Lengths of patterns that are searched together: a short one would shorten the jumps of all.
_LENGTHS = (8, 24)


def folded(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """All occurrences of many byte strings, none empty.

    shift has, for each block of the first m bytes of the patterns (m: their least length), how far its last occurrence
    there is from m; a block that occurs nowhere lets the window jump past itself. Where the shift is 0, the block picks
    a bucket, the first bytes of the window pick the patterns in it, and those are compared directly.
    """

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.b = b = max(1, min(8, m // 3))
        self.far = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[int]]] = {}
        for k, p in enumerate(patterns):
            for end in range(b, m + 1):
                block = p[end - b:end]
                self.shift[block] = min(self.shift.get(block, self.far), m - end)
            self.buckets.setdefault(p[m - b:m], {}).setdefault(p[:b], []).append(k)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(place, number of the pattern), by place."""
        m, b, far, shift = self.m, self.b, self.far, self.shift.get
        end, last = m, len(text)
        while end <= last:
            block = text[end - b:end]
            step = shift(block, far)
            if step:
                end += step
                continue
            at = end - m
            for k in self.buckets[block].get(text[at:at + b], ()):
                if text.startswith(self.patterns[k], at):
                    yield at, k
            end += 1


class Windows:
    """The distinct windows of some items, by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        owners: dict[bytes, set[str]] = {}
        self.width: dict[bytes, int] = {}
        for name, text in items:
            words = folded(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k:k + window]
                pattern = b" " + b" ".join(part) + b" "
                self.width[pattern] = len(part)
                owners.setdefault(pattern, set()).update([] if name is None else [name])
        self.owners = owners
        groups: dict[int, list[bytes]] = {}
        for p in owners:
            groups.setdefault(sum(len(p) >= x for x in _LENGTHS), []).append(p)
        self.searches = [WuManber(g) for g in groups.values()]

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged hit ranges of words (end exclusive), names of the items found."""
        words = folded(text)
        line = b" " + b" ".join(words) + b" "
        hits, names = [], set()
        for search in self.searches:
            word = at = 0
            for place, k in search.find(line):
                word += line.count(b" ", at, place)
                at = place
                pattern = search.patterns[k]
                hits.append((word, word + self.width[pattern]))
                names |= self.owners[pattern]
        return len(words), merged(hits), names


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
_COLUMNS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_bytes: int = 1 << 19, pass_bytes: int = 1 << 26,
) -> DataFrame:
    """row (struct of all columns of docs), n_words, n_hit (long), hits (ranges of words), items (ids as sorted strings).

    Every row gives one row. Null and blank texts have no words and no hits; an empty benchmark hits nothing. Items with
    fewer words than a window are one window, items without words none; repeated items count once; an item without an id
    hits but is not listed. Distinct items, long ones in parts that overlap by all but one word of a window, go to the
    tasks in blocks of about block_bytes. Their size is read first: up to pass_bytes, a task searches each batch of
    documents for one block after the other; beyond, the documents are passed over again and the findings of a row put
    together.
    """
    items = rows.checkpointed(_parts(benchmark.select(
        F.col(item_id).cast("string").alias("k"), F.col(item_text).alias("t")), window, block_bytes // 8))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-size // pass_bytes)
    if passes <= 1:
        return _search(docs, text, items, window, block_bytes)
    keyed = rows.checkpointed(docs.select(F.struct("*").alias("d"), F.monotonically_increasing_id().alias("k")))
    found = None
    for b in range(passes):
        part = _search(keyed.select("k", F.col("d")[text].alias("t")), "t",
                       items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(passes)) == b), window, block_bytes)
        part = part.select("row.k", "n_words", "hits", "items")
        found = part if found is None else found.unionAll(part)
    ranges = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("hits"))), F.array().cast(_SPANS),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["first"]),
            F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(
                F.element_at(acc, -1)["first"].alias("first"),
                F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))).otherwise(F.array_append(acc, x)))
    by_row = found.groupBy("k").agg(
        F.max("n_words").alias("n_words"), ranges.alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["first"])
    return keyed.join(by_row, "k").select(F.col("d").alias("row"), "n_words", n_hit.alias("n_hit"), "hits", "items")


def _parts(items: DataFrame, window: int, part_bytes: int) -> DataFrame:
    """k, t (binary): the words of items (k, t), each part of an item of about part_bytes, without repeated rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.pieces(batches):
            names, parts = [], []
            for k, text in zip(batch.column("k").to_pylist(), rows.texts(batch.column("t")), strict=True):
                words = folded(text)
                step = max(1, len(words) * part_bytes // max(1, len(text)))
                for at in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    names.append(k)
                    parts.append(b" ".join(words[at:at + step + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], names=["k", "t"])

    return rows.map_arrow(items.filter("t IS NOT NULL"), cut, "k string, t binary").distinct()


def _search(docs: DataFrame, text: str, items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """All rows against parts of items, which are sent in blocks; the driver holds a block and a partition of parts."""
    sent, block, size = [], [], 0
    context = docs.sparkSession.sparkContext
    for part in items.toLocalIterator():
        block.append((part["k"], bytes(part["t"])))
        size += len(part["t"])
        if size >= block_bytes:
            sent.append(context.broadcast(block))
            block, size = [], 0
    if block or not sent:
        sent.append(context.broadcast(block))

    def start() -> Callable[[list[bytes]], list[list]]:
        only = Windows(sent[0].value, window) if len(sent) == 1 else None

        def work(batch: list[bytes]) -> list[list]:
            n_words, hits, names = [0] * len(batch), [[] for _ in batch], [set() for _ in batch]
            for one in sent:
                windows = only or Windows(one.value, window)
                for k, x in enumerate(batch):
                    n_words[k], ranges, owners = windows.find(x)
                    if ranges:
                        hits[k] = merged(hits[k] + ranges)
                        names[k] |= owners
            return [
                n_words, [sum(b - a for a, b in x) for x in hits], [[{"first": a, "end": b} for a, b in x] for x in hits],
                [sorted(x) for x in names]]

        return work

    # several blocks: a batch as large as Spark hands it over, as the tables of each block are made anew for it
    return rows.map_texts(docs, text, start, _COLUMNS, rows.STEP_ROWS if len(sent) == 1 else None)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with all their columns."""
    return contamination(docs, benchmark, text, **options).filter("n_hit = 0").select("row.*")
