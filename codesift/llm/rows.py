"""Helpers for operators that work on Arrow batches, and for cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one step in Python: bounds what a task holds besides the batch that Spark hands over.
STEP_ROWS = 256
STEP_BYTES = 1 << 25


def pieces(batches: Iterator[pa.RecordBatch], rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of up to so many rows, fewer where they hold over STEP_BYTES; a row alone may be larger."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            piece = batch.slice(start, rows)
            while piece.num_rows > 1 and piece.nbytes > STEP_BYTES:
                piece = piece.slice(0, piece.num_rows // 2)
            yield piece
            start += piece.num_rows


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(
    docs: DataFrame, text: str, start: Callable[[], Callable[[list[bytes]], list[list]]], columns: list[T.StructField],
    step: int | None = STEP_ROWS,
) -> DataFrame:
    """row (struct of all columns of docs, so that no name can clash) and columns.

    start() is called once per task and gives the function from texts, null as empty, to one list per column. It gets
    step rows at a time, or, if step is None, as many as Spark hands over in a batch.
    """
    types = [T.StructField("row", docs.schema, False), *columns]
    arrow = [_arrow(c.dataType) for c in columns]
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches if step is None else pieces(batches, step):
            row = batch.column("row")
            found = work(texts(row.field(place)))
            yield pa.RecordBatch.from_arrays(
                [row, *[pa.array(x, kind) for x, kind in zip(found, arrow, strict=True)]],
                names=["row", *[c.name for c in columns]])

    return map_arrow(docs.select(F.struct("*").alias("row")), run, T.StructType(types))


def map_arrow(df: DataFrame, work: Callable, schema: object) -> DataFrame:
    """df.mapInArrow, with this package sent to the executors, which need no copy of their own."""
    _ship(df.sparkSession)
    return df.mapInArrow(work, schema)


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(os.path.join(tempfile.mkdtemp(), "codesift_llm.zip"), "w") as out:
        out.write(os.path.join(here, "..", "__init__.py"), "codesift/__init__.py")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                out.write(os.path.join(here, name), f"codesift/llm/{name}")
    context.addPyFile(out.filename)
    _SHIPPED.add(context.applicationId)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(),
        T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return simple[kind]


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a folder of our own, on a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; it goes when the session's file system closes."""
    context, folder = spark.sparkContext, _checkpoint_dir(spark)
    path = context._jvm.org.apache.hadoop.fs.Path(folder, f"{name}-{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def landed(df: DataFrame) -> DataFrame:
    """df written as Parquet below the shared folder and read from there: unlike checkpoint() in columns, compressed."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df and pos: its rows numbered from 0 in the order of columns, which must tell rows apart; df is written once.

    Rows are dealt out by ranges and sorted there; the sizes of the ranges, one row for each, give where each starts.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"))
    placed = checkpointed(placed)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("pid").count().select("pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(bases), "pid").select(*df.columns, (F.col("base") + F.col("seq")).alias("pos"))
