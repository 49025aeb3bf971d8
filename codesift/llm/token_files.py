"""Token files of directly addressable codes: any token of a file is read without decoding those around it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesift.llm import pretokens, rows

#: Bits of a rank directory entry; tokens after which a segment is closed.
_RANK_BITS = 512
SEGMENT_TOKENS = 1 << 20
_MAGIC = b"DAC1"


class Codes:
    """Numbers split into levels of 8 bits, lowest first.

    A level has the chunks of those numbers that reach it, a bitmap that tells which go on, and the number of ones before
    each 512 bits of it. Number i has its first chunk at i; if bit i is set, its next chunk is at the rank of bit i in
    the level above, and so on. Image: magic, levels, then for each level its count, chunks, bitmap and directory.
    """

    def __init__(self, image: bytes) -> None:
        if image[:4] != _MAGIC:
            raise ValueError("not an image of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", image, 4)[0]):
            n = struct.unpack_from("<Q", image, at)[0]
            at += 8
            chunks = np.frombuffer(image, np.uint8, n, at)
            at += n
            blocks = -(-n // _RANK_BITS)
            bitmap = np.frombuffer(image, np.uint8, blocks * _RANK_BITS // 8, at)
            at += len(bitmap)
            ranks = np.frombuffer(image, "<u8", blocks, at)
            at += 8 * blocks
            self.levels.append((chunks, bitmap, ranks))

    @staticmethod
    def image(numbers: np.ndarray) -> bytes:
        left, levels = numbers.astype(np.uint32), []
        while len(left):
            more = left > 255
            blocks = -(-len(left) // _RANK_BITS)
            bits = np.zeros(blocks * _RANK_BITS, np.uint8)
            bits[:len(left)] = more
            ones = bits.reshape(blocks, -1).sum(axis=1, dtype=np.uint64)
            ranks = np.cumsum(ones) - ones
            levels.append(struct.pack("<Q", len(left)) + (left & 255).astype(np.uint8).tobytes()
                          + np.packbits(bits, bitorder="little").tobytes() + ranks.astype("<u8").tobytes())
            left = left[more] >> 8
        return _MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def _rank(self, level: int, i: int) -> int:
        """Ones before place i of a level."""
        _, bitmap, ranks = self.levels[level]
        block, byte = i // _RANK_BITS, i >> 3
        if i >= len(bitmap) * 8:
            return int(ranks[-1] + np.bitwise_count(bitmap[-_RANK_BITS // 8:]).sum()) if len(ranks) else 0
        inside = bitmap[block * _RANK_BITS // 8:byte]
        return int(ranks[block]) + int(np.bitwise_count(inside).sum()) + (int(bitmap[byte]) & (1 << (i & 7)) - 1).bit_count()

    def between(self, start: int, end: int) -> np.ndarray:
        """Numbers start to end (exclusive), unsigned 32-bit."""
        out = np.zeros(max(0, end - start), "<u4")
        place = np.arange(len(out))
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if start >= end:
                break
            out[place] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            low = start >> 3
            bits = np.unpackbits(bitmap[low:(end + 7) >> 3], bitorder="little")[start - 8 * low:end - 8 * low]
            place = place[bits.astype(bool)]
            start, end = self._rank(k, start), self._rank(k, end)
        return out


_SEGMENT = "part int, segment int, inside long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


def _segments(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[pa.RecordBatch]:
    encode, part = pretokens.encoder().encode, TaskContext.get().partitionId()
    end = np.array([end_id], "<u4").tobytes()
    held: list[tuple[int | None, bytes]] = []
    number = size = inside = 0

    def closed() -> pa.RecordBatch:
        nonlocal inside, number, size
        ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
        before, this = inside, number
        inside, number, size = inside + len(ids), number + 1, 0
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([this], pa.int32()), pa.array([before], pa.int64()),
            pa.array([len(ids)], pa.int64()),
            pa.array([[k for k, _ in held]], pa.list_(pa.int64())),
            pa.array([[len(x) // 4 for _, x in held]], pa.list_(pa.int64())), pa.array([Codes.image(ids)], pa.binary()),
        ], names=["part", "segment", "inside", "n_tokens", "doc_ids", "lengths", "codes"])

    for batch in rows.pieces(batches):
        ids = encode([x.decode() for x in rows.texts(batch.column("t"))])
        for doc, x in zip(batch.column("d").to_pylist(), ids, strict=True):
            held.append((doc, x + end))
            size += len(x) // 4 + 1
            if size >= SEGMENT_TOKENS:
                yield closed()
                held.clear()
    if held:
        yield closed()


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Writes the ids of all texts, each followed by end_id, in ascending doc_id order (nulls first) below path.

    A row of the table is a segment: the image of Codes with the ids of some documents, and their doc_ids and lengths.
    Segments are ordered by (part, segment). Null and empty texts are their end_id alone; rows that share an id follow
    each other in the order they are read in. Texts are dealt out by ranges of (doc_id, place), so that no id is hot.
    """
    placed = docs.select(
        F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"),
        F.monotonically_increasing_id().alias("k"))
    ordered = placed.repartitionByRange("d", "k").sortWithinPartitions("d", "k").select("d", "t")
    rows.map_arrow(ordered, lambda batches: _segments(batches, end_id), _SEGMENT).write.option(
        "compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows.pieces(batches, 1):
        start, image = batch.column("start")[0].as_py(), batch.column("codes")[0].as_py()
        doc_ids, lengths = (batch.column(c)[0].as_py() for c in ("doc_ids", "lengths"))
        codes = Codes(image)
        ends = np.cumsum(lengths).tolist()
        crc = [zlib.crc32(codes.between(b - n, b).tobytes()) for n, b in zip(lengths, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([
            pa.array(doc_ids, pa.int64()), pa.array([start + b - n for n, b in zip(lengths, ends, strict=True)], pa.int64()),
            pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The table of write() and start: the ids before each segment, those inside its part and those of earlier parts."""
    table = spark.read.schema(_SEGMENT).parquet(path)
    sizes = table.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    # one row for each task that wrote: no more than tasks, whatever the data
    return table.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("inside"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens (with its end id), ids_crc32."""
    return rows.map_arrow(
        segments(spark, path).select("start", "doc_ids", "lengths", "codes"), _documents,
        "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """place, token (null beyond the files): single tokens by their place among all ids, each from its own segment."""
    table = segments(spark, path)
    bounds = table.select("part", "segment", "start", F.col("n_tokens").alias("size"))
    wide = SEGMENT_TOKENS
    near = bounds.select("*", F.explode(F.sequence(
        F.floor(F.col("start") / wide), F.floor((F.col("start") + F.col("size") - 1) / wide))).alias("cell"))
    asked = places.select(F.col(place).cast("long").alias("place")).distinct().withColumn("cell", F.floor(F.col("place") / wide))
    found = asked.join(near, "cell").filter("place >= start AND place < start + size")
    wanted = found.groupBy("part", "segment").agg(F.sort_array(F.collect_list(F.col("place") - F.col("start"))).alias("at"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.pieces(batches, 1):
            codes, at = Codes(batch.column("codes")[0].as_py()), batch.column("at")[0].as_py()
            start = batch.column("start")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([start + i for i in at], pa.int64()), pa.array([codes[i] for i in at], pa.int64())],
                names=["place", "token"])

    hits = rows.map_arrow(
        table.join(wanted, ["part", "segment"]).select("start", "codes", "at"), pick, "place long, token long")
    return places.select(F.col(place).cast("long").alias("place")).join(hits, "place", "left")
