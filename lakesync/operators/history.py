"""The history of checks: append-only runs, the latest run, what changed between two (V5, V6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesync.operators.audits import CHECK_COLUMNS, verdict
from lakesync.session import path_exists

HISTORY_SCHEMA = "target string, check_name string, success boolean, message string, validation_type string, run bigint"


def record_checks(checks: DataFrame, path: str, run: int) -> None:
    """Append the check rows of one run to the history at ``path``.

    A run that is recorded again, after a failure, replaces its own rows; the
    rows of other runs are never touched."""
    checks.select(*CHECK_COLUMNS).write.mode("overwrite").option("compression", "snappy").parquet(f"{path.rstrip('/')}/run={int(run)}")


def check_history(spark: SparkSession, path: str) -> DataFrame:
    """All recorded check rows, with their ``run``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def latest_checks(history: DataFrame) -> DataFrame:
    """Of every check the row of the last run that made it.

    ``rank`` over the window is cut on the map side, so a target with a third of
    all rows reaches its reduce task as one run a task."""
    own = Window.partitionBy("target", "check_name", "validation_type").orderBy(F.col("run").desc())
    return history.withColumn("_r", F.rank().over(own)).where("_r = 1").drop("_r")


def verdict_changes(before: DataFrame, after: DataFrame, mode: str = "all") -> DataFrame:
    """Targets whose verdict differs between two sets of check rows: ``target, change, failed_before, failed_after``.

    ``change``: ``newly failing``, ``newly passing``, ``appeared`` or ``disappeared``;
    a target that keeps its verdict has no row."""

    def folded(checks: DataFrame, name: str) -> DataFrame:
        return verdict(checks, "target", mode).select("target", F.col("success").alias(f"_{name}"), F.col("n_failed").alias(f"failed_{name}"))

    both = folded(before, "before").join(folded(after, "after"), "target", "full_outer")
    was, now = F.col("_before"), F.col("_after")
    change: Column = (F.when(was.isNull(), F.lit("appeared")).when(now.isNull(), F.lit("disappeared"))
                      .when(was & ~now, F.lit("newly failing")).when(~was & now, F.lit("newly passing")))
    return both.select("target", change.alias("change"), "failed_before", "failed_after").where("change is not null")


def run_changes(history: DataFrame, before: int, after: int, mode: str = "all") -> DataFrame:
    """:func:`verdict_changes` of two recorded runs; only their folders are read."""
    return verdict_changes(history.where(F.col("run") == int(before)), history.where(F.col("run") == int(after)), mode)


__all__ = ["record_checks", "check_history", "latest_checks", "verdict_changes", "run_changes"]
