"""The findings store: Parquet tables, read back with fixed schemas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift import schemas as S


# A findings table is a folder of snapshots: data/save=<id>/job_id=<job>/ holds the rows of a job as one save wrote them,
# and the file CURRENT names the folders that count. It is replaced in one step, last of all, so a save that stops before
# leaves the table as it was, and a reader sees the rows before a save or those after it.
CURRENT = "CURRENT"


def _file_system(spark: SparkSession, path: str) -> tuple:
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def current_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders below data/ that hold the table; none if nothing has been saved. One line a job."""
    hadoop, system = _file_system(spark, path)
    manifest = hadoop.Path(path, CURRENT)
    if not system.exists(manifest):
        return []
    stream = system.open(manifest)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")[:-1]
    finally:
        stream.close()


def swap_folders(spark: SparkSession, path: str, before: list[str], after: list[str]) -> None:
    """Let CURRENT name other folders. An error if another save has done so since before was read."""
    hadoop, system = _file_system(spark, path)
    if current_folders(spark, path) != before:
        raise RuntimeError(f"another save has changed {path}; read it again")
    draft = hadoop.Path(path, f"{CURRENT}.{uuid.uuid4().hex}")
    stream = system.create(draft)
    stream.write(bytearray("".join(f"{x}\n" for x in after), "utf-8"))
    stream.close()
    option = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    manifest = system.makeQualified(hadoop.Path(path, CURRENT))
    hadoop.FileContext.getFileContext(manifest.toUri(), spark._jsc.hadoopConfiguration()).rename(
        system.makeQualified(draft), manifest, options)


def save_findings(findings: DataFrame, path: str) -> None:
    """Insert or replace findings by id; all others stay, those of the same jobs too. Only the jobs named are written anew."""
    spark = findings.sparkSession
    before = current_folders(spark, path)
    if before:
        jobs = findings.select("job_id").distinct()
        others = load_findings(spark, path).join(jobs, "job_id", "left_semi").join(findings.select("id"), "id", "left_anti")
        findings = findings.unionByName(others.select(*findings.columns))
    folder = f"save={uuid.uuid4().hex}"
    findings.write.partitionBy("job_id").parquet(f"{path}/data/{folder}")
    hadoop, system = _file_system(spark, path)
    written = [f"{folder}/{x.getPath().getName()}" for x in system.listStatus(hadoop.Path(f"{path}/data/{folder}")) if x.isDirectory()]
    renewed = {x.split("/")[1] for x in written}
    swap_folders(spark, path, before, [x for x in before if x.split("/")[1] not in renewed] + written)


def load_findings(spark: SparkSession, path: str) -> DataFrame:
    folders = [f"{path}/data/{x}" for x in current_folders(spark, path)]
    if not folders:
        return spark.createDataFrame([], S.FINDINGS)
    return spark.read.schema(S.FINDINGS).option("basePath", f"{path}/data").parquet(*folders).select(*S.FINDINGS.fieldNames())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see: below spark.checkpoint.dir, or a local one where the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        base = tempfile.mkdtemp(prefix="codesift-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_jobs(jobs: DataFrame, path: str, seq: int) -> None:
    """Append job rows; the reader keeps the latest row of an id."""
    jobs.withColumn("seq", F.lit(seq).cast("bigint")).write.mode("append").parquet(path)


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(S.JOBS.fields + [T.StructField("seq", T.LongType())])
    return latest_by_id(spark.read.schema(schema).parquet(path)).drop("seq")


def latest_by_id(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Last write wins. The rank bound prunes each partition to one row per id before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def upsert(base: DataFrame, updates: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Insert or replace by id: updates carry seq > that of the base."""
    return latest_by_id(base.unionByName(updates), key, seq)


def to_payload(rows: DataFrame) -> DataFrame:
    """id and the whole row as one JSON text."""
    return rows.select("id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("payload"))


def from_payload(payloads: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows from JSON texts; a malformed text is an error."""
    return payloads.select(F.from_json("payload", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def export_rows(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """Everything as JSON rows (kind, id, payload): write with write_export; no row holds a whole table."""
    return to_payload(jobs).withColumn("kind", F.lit("job")).unionByName(
        to_payload(findings).withColumn("kind", F.lit("finding"))).select("kind", "id", "payload")


def write_export(jobs: DataFrame, findings: DataFrame, path: str) -> None:
    export_rows(jobs, findings).write.mode("overwrite").partitionBy("kind").json(path)
