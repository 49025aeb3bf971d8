"""Source files as tables: a directory tree, a landed snapshot of remote repositories, and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesift import schemas as S
from codesift.functions import text as X


SUPPORTED_NAMES = "*.{" + ",".join(
    "".join(f"[{c}{c.upper()}]" for c in suffix[1:]) for suffix in S.SUFFIX_LANGUAGE) + "}"


def list_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Every regular file under a directory: path relative to it and size. The bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size"))


def _relative(path: Column, root: str) -> Column:
    """The part of a file URI behind the root directory, whatever the scheme."""
    plain = root.rstrip("/").split("://")[-1].removeprefix("file:")
    at = F.instr(path, plain + "/")
    return F.substring(path, at + len(plain) + 1, F.length(path))


def scan_local_tree(spark: SparkSession, root: str, repo: str = "", ref: str = "local",
                    max_file_bytes: int | None = None) -> DataFrame:
    """source_files of a directory: supported paths with whole text; files that are not UTF-8 are dropped.

    Names without a supported suffix are left out while listing, so that data files of any size beside the sources are
    never opened; the test on the path stays behind it. max_file_bytes is pushed to the listing too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", SUPPORTED_NAMES).load(root)
    path = _relative(F.col("path"), root)
    files = files.withColumn("rel", path).where(X.is_supported(F.col("rel")))
    if max_file_bytes is not None:
        files = files.where(F.col("length") <= max_file_bytes)
    name = repo or "local/" + root.rstrip("/").split("/")[-1]
    return (
        files.where(F.is_valid_utf8(F.col("content").cast("string")))
        .select(
            F.lit(name).alias("repo"), F.lit(ref).alias("ref"), F.col("rel").alias("path"),
            F.sha1("content").alias("sha"), F.col("length").alias("size"),
            F.col("content").cast("string").alias("content"),
        )
    )


def listed_files(tree: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Blobs of a listing that the audit reads: supported path, and at most max_file_bytes where given (a missing size is 0)."""
    kept = tree.where((F.col("type") == "blob") & X.is_supported(F.coalesce("path", F.lit(""))))
    return kept if max_file_bytes is None else kept.where(F.coalesce("size", F.lit(0)) <= max_file_bytes)


def cap_files(tree: DataFrame, max_files: int) -> DataFrame:
    """The first max_files entries of each repository in listing order (this limit is the feature).

    row_number with a bound prunes every partition to max_files rows before the shuffle, so one huge repository
    does not end up in one task.
    """
    order = Window.partitionBy("repo", "ref").orderBy("pos")
    return tree.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_files).drop("nth")


def snapshot_files(tree: DataFrame, blobs: DataFrame, max_file_bytes: int | None = None,
                   max_files: int | None = None) -> DataFrame:
    """source_files of a landed snapshot: listing rows joined to fetched contents; a failed fetch has no row.

    Nothing is left out by default; S.MAX_FILE_BYTES and S.MAX_FILES are the limits of a remote scan.
    """
    kept = listed_files(tree, max_file_bytes)
    if max_files is not None:
        kept = cap_files(kept, max_files)
    return kept.join(blobs.select("repo", "ref", "path", "content"), ["repo", "ref", "path"]).select(
        "repo", "ref", "path", F.coalesce("sha", F.lit("")).alias("sha"), "size", "content")


def union_sources(remote: DataFrame, local: DataFrame, local_dir: str) -> DataFrame:
    """Both kinds of sources with their label; a local source without a repository is named after its directory."""
    named = F.coalesce(F.nullif(F.col("repo"), F.lit("")), F.lit(f"local/{local_dir}"))
    return remote.withColumn("source", F.lit("github")).unionByName(
        local.withColumn("repo", named).withColumn("source", F.lit("local")))


def normalise_repo(repo: Column) -> Column:
    """owner/name, or NULL when the text is not exactly that."""
    cleaned = F.regexp_replace(F.regexp_replace(X.strip(repo), r"^https://github\.com/", ""), r"\.git$", "")
    parts = F.filter(F.split(cleaned, "/"), lambda p: p != "")
    return F.when(F.size(parts) == 2, F.array_join(parts, "/"))


def normalise_ref(ref: Column, default_branch: Column) -> Column:
    """Branch name without refs/ and heads/; empty falls back to the default branch, then main."""
    asked = F.coalesce(F.nullif(ref, F.lit("")), F.nullif(default_branch, F.lit("")), F.lit("main"))
    return F.regexp_replace(F.regexp_replace(asked, "^refs/", ""), "^heads/", "")
