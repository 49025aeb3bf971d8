"""Ranked lexical search: MaxScore over an index of segments, with bounds of single terms and of pairs of terms.

The documents' postings of all query terms are kept in segments of bounded size. A segment holds, by block of documents,
the largest impact of every term and, for pairs of terms that queries ask together, the list of blocks in which both
meet in a document, with the largest sum of their impacts there. A block is only opened for a query if the bounds of its
pairs reach the score that the query's last result has for certain.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm import rows

#: Constants of the score.
UNIT, FLAT, LONG, HALF = 1_000_000_000, 1000, 20, 50
#: Everything but 0-9, A-Z, a-z and what is beyond ASCII parts terms; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of a block; postings after which a segment is closed; bytes of text that are cut into terms at once.
BLOCK, SEGMENT_POSTINGS, _STEP = 64, 1 << 18, 1 << 20
#: Places of a list whose values are reported to bound the scores of results from below.
_PLACES = (1, 2, 4, 8, 16, 32)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, in lists of bounded size."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= _STEP else folded.find(b" ", at + _STEP)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary, ascending), tfs; for documents with a term."""
    kind = docs.schema[doc_id].dataType
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(shared.value)}
        for batch in rows.pieces(batches):
            keep, sizes, found, tfs = [], [], [], []
            for k, body in enumerate(rows.texts(batch.column("t"))):
                n, seen = 0, Counter()
                for part in terms(body):
                    n += len(part)
                    seen.update(map(number.get, part))
                if n:
                    seen.pop(None, None)
                    own = sorted(seen)
                    keep.append(k)
                    sizes.append(n)
                    found.append(own)
                    tfs.append([seen[t] for t in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"])

    return rows.map_arrow(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), count, T.StructType([
        T.StructField("doc_id", kind), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))]))


@dataclass(frozen=True)
class Query:
    """Units are pairs of terms, the lower number first, or single terms; no term is in two of them. The pairs must be among
    those that the segments were built with."""

    number: int
    units: tuple[tuple[int, ...], ...]


@dataclass(frozen=True)
class Statistics:
    """documents with a term, their terms, and the weight of every term of the vocabulary; 0 where no document has it."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each posting adds to a score, in whole numbers."""
        # a product beyond 64 bits needs a document of billions of terms in a corpus of billions
        m = (100 - HALF) + HALF * n * self.documents // self.length
        return self.weights[term] * (UNIT * tf // (FLAT * tf + LONG * m))


def statistics(postings: DataFrame, size: int) -> Statistics:
    n, length = postings.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(size, np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    return Statistics(n, int(length or 0), weights)


def queries(texts: list[bytes], numbers: dict[bytes, int], weights: np.ndarray) -> list[Query]:
    """Terms that add to scores, once each; neighbours by weight, which documents are likely to share alike, are pairs."""
    out = []
    for k, text in enumerate(texts):
        own = {numbers[t] for part in terms(text) for t in part}
        ranked = sorted((t for t in own if weights[t] > 0), key=lambda t: (-weights[t], t))
        out.append(Query(k, tuple(tuple(sorted(ranked[i:i + 2])) for i in range(0, len(ranked), 2))))
    return out


@dataclass
class _Lists:
    """Sorted keys with a stretch each of parallel arrays."""

    keys: np.ndarray
    starts: np.ndarray

    def find(self, key: int) -> slice | None:
        k = int(np.searchsorted(self.keys, key))
        if k == len(self.keys) or self.keys[k] != key:
            return None
        return slice(int(self.starts[k]), int(self.starts[k + 1]))


class Segment:
    """Postings by term, largest impacts by term and block, and by pair and block where both terms meet in a document."""

    FIELDS = {
        "doc_ids": None, "term": pa.int32(), "term_at": pa.int64(), "doc": pa.int32(), "impact": pa.int64(),
        "top_at": pa.int64(), "top_block": pa.int32(), "top": pa.int64(), "top_post": pa.int64(),
        "pair": pa.int64(), "pair_at": pa.int64(), "pair_block": pa.int32(), "pair_top": pa.int64(), "places": pa.int64(),
    }

    def __init__(self, fields: dict[str, np.ndarray], size: int) -> None:
        self.f, self.size = fields, size
        self.blocks = -(-size // BLOCK)
        self.postings = _Lists(fields["term"], fields["term_at"])
        self.tops = _Lists(fields["term"], fields["top_at"])
        self.pairs = _Lists(fields["pair"], fields["pair_at"])

    @staticmethod
    def built(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, pairs: np.ndarray, vocabulary: int) -> dict[str, np.ndarray]:
        """Fields but for doc_ids. pairs: a * vocabulary + b, sorted. places: (key, value, rank) of the largest values."""
        order = np.lexsort((doc, term))
        term, doc, impact = term[order], doc[order].astype(np.int64), impact[order]
        starts = np.flatnonzero(np.r_[True, np.diff(term) != 0]) if len(term) else np.zeros(0, np.int64)
        cells = term.astype(np.int64) * (1 << 32) | doc // BLOCK
        heads = np.flatnonzero(np.r_[True, np.diff(cells) != 0]) if len(term) else np.zeros(0, np.int64)
        lists = _Lists(term[starts], np.r_[starts, len(term)])
        places, kept, at, blocks, tops = [], [], [0], [], []
        for k, t in enumerate(lists.keys.tolist()):
            places += _places(-1 - t, impact[lists.starts[k]:lists.starts[k + 1]])
        for pair in pairs.tolist():
            a, b = (lists.find(t) for t in divmod(pair, vocabulary))
            if a is None or b is None:
                continue
            if a.stop - a.start > b.stop - b.start:
                a, b = b, a
            where = np.minimum(np.searchsorted(doc[b], doc[a]), b.stop - b.start - 1)
            met = np.flatnonzero(doc[b][where] == doc[a])
            if len(met):
                joint, block = impact[a][met] + impact[b][where[met]], doc[a][met] // BLOCK
                first = np.flatnonzero(np.r_[True, np.diff(block) != 0])
                kept.append(pair)
                blocks.append(block[first])
                tops.append(np.maximum.reduceat(joint, first))
                at.append(at[-1] + len(first))
                places += _places(pair, joint)
        none = [np.zeros(0, np.int64)]
        return {
            "term": lists.keys, "term_at": lists.starts, "doc": doc, "impact": impact,
            "top_at": np.searchsorted(heads, lists.starts), "top_block": doc[heads] // BLOCK,
            "top": np.maximum.reduceat(impact, heads) if len(heads) else none[0], "top_post": np.r_[heads, len(term)],
            "pair": np.array(kept, np.int64), "pair_at": np.array(at), "pair_block": np.concatenate(blocks or none),
            "pair_top": np.concatenate(tops or none), "places": np.array(places, np.int64).reshape(-1)}

    def bounds(self, unit: tuple[int, ...], vocabulary: int) -> np.ndarray:
        """By block, what the terms of a unit can add to the score of one document at most.

        A document with both terms of a pair has no more than the pair's joint maximum, one with a single term no more
        than that term's: the larger of the three bounds is at most, and mostly less than, the sum of the two terms'.
        """
        out = np.zeros(self.blocks, np.int64)
        for t in unit:
            at = self.tops.find(t)
            if at is not None:
                where = self.f["top_block"][at]
                out[where] = np.maximum(out[where], self.f["top"][at])
        if len(unit) == 2 and (at := self.pairs.find(unit[0] * vocabulary + unit[1])) is not None:
            where = self.f["pair_block"][at]
            out[where] = np.maximum(out[where], self.f["pair_top"][at])
        return out

    def opened(self, term: int, alive: np.ndarray) -> np.ndarray:
        """Places of the postings of a term in the blocks that are alive."""
        at = self.tops.find(term)
        if at is None:
            return np.zeros(0, np.int64)
        cells = at.start + np.flatnonzero(alive[self.f["top_block"][at]])
        first, size = self.f["top_post"][cells], self.f["top_post"][cells + 1] - self.f["top_post"][cells]
        return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())

    def search(self, query: Query, least: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) that may score least or more, and their scores; none that does is missing."""
        each = [self.bounds(u, vocabulary) for u in query.units]
        alive = sum(each, np.zeros(self.blocks, np.int64)) >= max(least, 1)
        if not alive.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        most = [int(x[alive].max()) for x in each]
        order = sorted(range(len(each)), key=lambda k: -most[k])
        left = np.cumsum([0, *[most[k] for k in reversed(order)]])[::-1]  # what units from the k-th on can add
        scores = np.zeros(self.blocks * BLOCK, np.int64)
        among = None
        for k, unit in enumerate(order):
            if among is None and left[k] < max(least, 1):
                # documents without any term so far cannot reach least
                among = np.flatnonzero(scores)
            if among is not None:
                among = among[scores[among] + left[k] >= least]
                alive = np.zeros(self.blocks, bool)
                alive[among // BLOCK] = True
            for t in query.units[unit]:
                at = self.opened(t, alive)
                scores[self.f["doc"][at]] += self.f["impact"][at]
        found = np.flatnonzero(scores) if among is None else among
        return found, scores[found]


def _places(key: int, values: np.ndarray) -> list[int]:
    """key, value, rank of the values at some ranks, largest first; at least rank values are as large."""
    top = np.sort(np.partition(values, -_PLACES[-1])[-_PLACES[-1]:] if len(values) > _PLACES[-1] else values)[::-1]
    out = []
    for rank in _PLACES:
        if rank <= len(top):
            out += [key, int(top[rank - 1]), rank]
    return out


def indexed(postings: DataFrame, found: Statistics, pairs: list[int], vocabulary: int) -> DataFrame:
    """Segments of the documents of postings, one row each: doc_ids and the fields of Segment."""
    shared = postings.sparkSession.sparkContext.broadcast((found, np.array(sorted(pairs), np.int64)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, wanted = shared.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            one = {c: table.column(c).combine_chunks() for c in table.column_names}
            counts = np.diff(one["terms"].offsets.to_numpy())
            doc = np.repeat(np.arange(len(counts)), counts)
            term, tf = (one[c].flatten().to_numpy() for c in ("terms", "tfs"))
            impact = stats.impacts(term, tf, one["n"].to_numpy()[doc])
            useful = impact > 0
            fields = Segment.built(term[useful], doc[useful], impact[useful], wanted, vocabulary)
            names = list(Segment.FIELDS)
            ids = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), one["doc_id"])
            return pa.RecordBatch.from_arrays(
                [ids, *[pa.array([fields[c]], pa.list_(Segment.FIELDS[c])) for c in names[1:]]], names=names)

        for batch in rows.pieces(batches):
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= SEGMENT_POSTINGS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    kinds = {pa.int32(): T.IntegerType(), pa.int64(): T.LongType()}
    return rows.map_arrow(postings, build, T.StructType([
        T.StructField("doc_ids", T.ArrayType(postings.schema["doc_id"].dataType)),
        *[T.StructField(c, T.ArrayType(kinds[k])) for c, k in Segment.FIELDS.items() if k is not None]]))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Segment, pa.Array]]:
    for batch in batches:
        for k in range(batch.num_rows):
            fields = {c: batch.column(c)[k].values for c in Segment.FIELDS}
            ids = fields.pop("doc_ids")
            yield Segment({c: v.to_numpy() for c, v in fields.items()}, len(ids)), ids


def surest(index: DataFrame, top: int) -> dict[int, int]:
    """By list (pair, or -1 - term), a value that top documents reach for certain; lists that are shorter are missing.

    Segments say how many documents have a value or more at some ranks of a list; these counts add up over segments.
    """
    triples = index.where(F.size("places") > 0).select(F.explode(F.transform(
        F.sequence(F.lit(0), F.size("places") - 3, F.lit(3)), lambda k: F.slice("places", k + 1, 3))).alias("p"))
    place = triples.select(F.col("p")[0].alias("key"), F.col("p")[1].alias("value"), F.col("p")[2].alias("rank"))
    # rank r stands for the places since the rank before it, half as large
    counts = place.groupBy("key", "value").agg(F.sum(F.when(F.col("rank") == 1, 1).otherwise(F.col("rank") / 2)).alias("n"))
    upto = Window.partitionBy("key").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumn("seen", F.sum("n").over(upto)).where(F.col("seen") >= top)
    return {r["key"]: r["value"] for r in reached.groupBy("key").agg(F.max("value").alias("value")).collect()}


def found_in(index: DataFrame, wanted: list[Query], least: dict[int, int], vocabulary: int, top: int) -> DataFrame:
    """query, doc_id, score: the documents of each task that can be among the top of a query."""
    kind = index.schema["doc_ids"].dataType.elementType
    shared = index.sparkSession.sparkContext.broadcast((wanted, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, known = shared.value
        floor = [max([known.get(key, 1) for u in q.units for key in _keys(u, vocabulary)], default=1) for q in every]
        best: list[list[int]] = [[] for _ in every]  # the scores of up to top documents, the least first
        for segment, ids in _segments(batches):
            query, place, score = [], [], []
            for q, heap in zip(every, best, strict=True):
                found, scores = segment.search(q, floor[q.number], vocabulary)
                keep = scores >= floor[q.number]
                found, scores = found[keep], scores[keep]
                if len(found) > top:
                    order = pc.sort_indices(
                        pa.table({"score": scores, "id": ids.take(pa.array(found))}),
                        sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end").to_numpy()[:top]
                    found, scores = found[order], scores[order]
                for s in scores.tolist():
                    if len(heap) < top:
                        heapq.heappush(heap, s)
                    elif s > heap[0]:
                        heapq.heapreplace(heap, s)
                if len(heap) == top:
                    floor[q.number] = max(floor[q.number], heap[0])
                query.append(np.full(len(found), q.number))
                place.append(found)
                score.append(scores)
            if query:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(query), pa.int32()), ids.take(pa.array(np.concatenate(place))),
                     pa.array(np.concatenate(score), pa.int64())], names=["query", "doc_id", "score"])

    return rows.map_arrow(index, search, T.StructType([
        T.StructField("query", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())]))


def _keys(unit: tuple[int, ...], vocabulary: int) -> list[int]:
    return [-1 - t for t in unit] + ([unit[0] * vocabulary + unit[1]] if len(unit) == 2 else [])


def ranked(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text",
           item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """row (struct of all columns of items), rank (from 1), doc_id, score: the top documents of each item, best first.

    Documents with equal scores are ranked by ascending doc_id, null ids last; rows that share an id are documents of
    their own. Fewer than top rows are given where fewer documents score above 0, none for items that are null or
    without terms. Repeated items give their rows each. Empty tables give no rows. The items' texts are collected, in
    blocks of about block_bytes of distinct text (a single longer one is a block of its own); each block is one pass over
    the documents. Documents are held as their postings of the block's terms, segment by segment, whatever their number.
    """
    asked = items.select(F.struct("*").alias("row"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    texts = asked.select("t").distinct().withColumn("size", F.octet_length("t").cast("long"))
    blocks = max(1, -(-(texts.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    out = None
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).select("t")
        found = _block(docs, [r["t"].encode() for r in own.collect()], top, doc_id, text)
        out = found if out is None else out.unionByName(found)
    key = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    best = out.withColumn("rank", F.row_number().over(key)).where(F.col("rank") <= top)
    keyed = asked.withColumn("key", F.sha1("t"))
    return keyed.join(best, "key").select("row", "rank", "doc_id", "score")


def _block(docs: DataFrame, texts: list[bytes], top: int, doc_id: str, text: str) -> DataFrame:
    """key (SHA-1 of the item's text), doc_id, score for one block of items."""
    spark = docs.sparkSession
    texts = sorted(texts)
    vocabulary = sorted({t for x in texts for part in terms(x) for t in part})
    numbers, size = {t: k for k, t in enumerate(vocabulary)}, max(1, len(vocabulary))
    postings = rows.landed(counted(docs, vocabulary, doc_id, text))
    stats = statistics(postings, size)
    wanted = queries(texts, numbers, stats.weights)
    pairs = {u[0] * size + u[1] for q in wanted for u in q.units if len(u) == 2}
    index = rows.landed(indexed(postings, stats, list(pairs), size))
    hits = found_in(index, wanted, surest(index, top), size, top)
    names = spark.createDataFrame([(k, hashlib.sha1(x).hexdigest()) for k, x in enumerate(texts)], "query int, key string")
    return hits.join(F.broadcast(names), "query").select("key", "doc_id", "score")
