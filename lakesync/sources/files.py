"""Partitioned Parquet scans, file manifests and storage listings."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesync.session import child_folders, existing_paths, qualify


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a hive-style partitioned Parquet table.

    Pass the stored ``schema`` (partition column included) so partition values
    keep their type: ``event_date=2024-01-01`` must come back as DATE, not as a
    guessed type.
    """
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_partitions(spark: SparkSession, base: str, pattern: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read the partitions of ``base`` that match a glob such as
    ``event_date=2024-01-*`` (S4).

    ``basePath`` keeps the partition column in the result even though only
    sub-directories are listed, so unmatched partitions are never opened.
    """
    r = spark.read.option("basePath", base)
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{base.rstrip('/')}/{pattern}")


def file_manifest(df: DataFrame, partition_cols: list[str] | None = None) -> DataFrame:
    """One row per data file: path, size, partition values and row count.

    Only the hidden ``_metadata`` columns (and partition columns) are read, so
    the scan decodes no data column; rows are counted per file with a partial
    aggregate inside each task before any shuffle.
    """
    parts = partition_cols or []
    return (df.select(F.col("_metadata.file_path").alias("file_path"),
                      F.col("_metadata.file_size").alias("file_size"), *parts)
            .groupBy("file_path", "file_size", *parts)
            .agg(F.count(F.lit(1)).alias("row_count")))


_LISTING_SCHEMA = "root string, path string, length bigint, root_exists boolean"


# a root list of fewer characters is broadcast to the file listing
ROOTS_BROADCAST_BYTES = 4 << 20


def storage_listing(spark: SparkSession, roots: list[str], list_files: bool = True) -> DataFrame:
    """Files under each root, plus one marker row per root (input of V3).

    Root existence costs a metadata call per root, or one listing of a
    parent folder that holds many of them (see
    :func:`lakesync.session.existing_paths`).  All existing
    roots are then listed by a single ``binaryFile`` scan that reads only
    ``path`` and ``length`` (no file content is opened; Spark lists large
    trees with a distributed job).  Each file is attributed to its root by an
    equi-join of the file's ancestor folders with the root list, so no
    per-root scan and no prefix (non-equi) join is needed.  A missing root
    gets a marker with ``root_exists = false``; an existing empty root lists
    no files and its marker passes.  With ``list_files=False`` only the
    markers are returned: an existence check that costs no listing of the
    roots' contents, whatever their size.
    """
    exists = existing_paths(spark, roots)
    markers = spark.createDataFrame([(r, None, None, exists[r]) for r in roots], _LISTING_SCHEMA)
    present = [r for r in roots if exists[r]]
    if not present or not list_files:
        return markers
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(present).select("path", "length"))
    root_map = spark.createDataFrame([(qualify(spark, r), r) for r in present], "_anc string, root string")
    parts = F.split("path", "/")
    # only the ancestors at the depths the roots have, usually one row per file
    depths = sorted({len(qualify(spark, r).split("/")) for r in present})
    ancestors = F.filter(F.array(*[F.when(F.size(parts) > n, F.array_join(F.slice(parts, 1, n), "/")) for n in depths]), lambda a: a.isNotNull())
    if sum(len(r) for r in present) < ROOTS_BROADCAST_BYTES:
        root_map = F.broadcast(root_map)
    attributed = (files.select("path", "length", F.explode(ancestors).alias("_anc"))
                  .join(root_map, "_anc")
                  .select("root", "path", "length", F.lit(True).alias("root_exists")))
    return markers.unionByName(attributed)


def storage_partitions(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """Distinct partition values that have a folder under the table root.

    One listing of the root: partition folders are named, not their files
    listed, so the cost follows the number of partitions, not of files.  The
    catalog repair command registers partitions from the same folders.
    """
    prefix = f"{partition}="
    values = [unquote(name[len(prefix):]) for name in child_folders(spark, path) if name.startswith(prefix)]
    return spark.createDataFrame([(v,) for v in sorted(set(values))], f"{partition} string")
