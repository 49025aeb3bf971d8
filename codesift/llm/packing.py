"""Packing of token pieces into sequences by minimum bin slack on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm import pretokens, rows

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit; null unless with_ids).

    The ids of a whole text and end_id; only documents of more than size ids are cut, into pieces of size ids, and what
    is left over is the first piece. Null and empty texts are their end_id alone. Each row of docs gives its pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pretokens.encoder().encode
        for batch in rows.pieces(batches):
            doc, number, start, length, crc, ids = [], [], [], [], [], []
            for name, x in zip(batch.column("d").to_pylist(), encode([x.decode() for x in rows.texts(batch.column("t"))]), strict=True):
                x += end
                n = len(x) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = x[4 * a:4 * b]
                    for column, value in zip((doc, number, start, length, crc, ids),
                                             (name, k, a, b - a, zlib.crc32(part), part if with_ids else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    plain = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.map_arrow(plain, run, _PIECE)


def fullest(counts: dict[int, int], space: int) -> dict[int, int]:
    """Lengths and how many of each fill most of space: subset sums as the bits of one number, longest lengths first."""
    whole = (1 << space + 1) - 1
    steps, reach = [], 1
    for length in sorted((x for x, n in counts.items() if n and x <= space), reverse=True):
        steps.append((length, reach))
        left = min(counts[length], space // length)
        copies = 1
        while left:
            take = min(copies, left)
            reach |= reach << take * length & whole
            left, copies = left - take, copies * 2
        if reach >> space & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = 0
        while not before >> total - k * length & 1:
            k += 1
        if k:
            used[length] = k
            total -= k * length
    return used


def plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, lengths in each): minimum bin slack.

    Each sequence starts with the longest piece left and takes the combination that fills it most. As long as there are
    pieces for that combination it stays the fullest, so it is used as often as they last. The work depends on the
    distinct lengths, not on the number of pieces.
    """
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        use = fullest(left, size - longest)
        left[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times = min(left[x] // k for x, k in use.items())
        out.append((times, use))
        for x, k in use.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return out


def _slots(plan_: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, pieces of that length in a sequence, their first offset); sequences."""
    out, used, sequence = [], {}, 0
    for times, use in plan_:
        offset = 0
        for length, k in use.items():
            rank = used.get(length, 0)
            out.append((length, rank, sequence, k, offset))
            used[length] = rank + times * k
            offset += length * k
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5), sequence


#: Pieces of one length that are numbered in one group.
_GROUP = 256


def packed(parts: DataFrame, size: int = 1024) -> DataFrame:
    """parts (length, 1 to size, and any other columns but k) and sequence_id, offset.

    The histogram of lengths, at most size rows, is all that the driver sees. Pieces of a length are numbered in salted
    groups, with the sizes of the groups before added, and find their place by length and number. Full pieces are a
    sequence each. parts is written once, as its rows are numbered. Every row gets a place; an empty table stays empty.
    """
    columns = parts.columns
    parts = rows.checkpointed(parts.withColumn("k", F.monotonically_increasing_id()))
    histogram = parts.filter(F.col("length") < size).groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}
    slots, sequences = _slots(plan(counts, size))
    groups = parts.sparkSession.createDataFrame(
        [(x, -(-n // _GROUP)) for x, n in counts.items()], "length long, groups int")
    salted = parts.join(F.broadcast(groups), "length").withColumn(
        "salt", F.pmod(F.xxhash64("k"), F.col("groups")).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("k")) - 1
    ranked = salted.withColumn("number", number).join(bases, ["length", "salt"]).select(
        *columns, (F.col("base") + F.col("number")).alias("rank"))
    schema = parts.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(slot[:, 2] + nth // slot[:, 3], pa.int64()),
                 pa.array(slot[:, 4] + nth % slot[:, 3] * length, pa.int64())],
                names=[*columns, "sequence_id", "offset"])

    full = parts.filter(F.col("length") >= size).select(
        *columns, (F.col("k") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rows.map_arrow(ranked, place, schema).unionByName(full)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (binary) of each sequence of packed() over pieces with ids, in the order of offsets."""
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
