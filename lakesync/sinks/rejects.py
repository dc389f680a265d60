"""Rejected rows, kept with their reasons and replayed once they are corrected (F2).

The store is a table of (``_raw``, ``_reject_reason``) partitioned by ``batch``.  A
batch's rejects replace whatever the store holds under its id, so a batch that is
replayed after a failure adds no row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.functions.conform import RAW, REJECT_REASON
from lakesync.session import path_exists
from lakesync.sinks.commit import recover
from lakesync.sinks.table import write_table

REJECTS_SCHEMA = f"{RAW} string, {REJECT_REASON} string, batch string"


def store_rejects(rejected: DataFrame, path: str, batch: str) -> None:
    """Write the rejects of one batch; those of an earlier attempt at it are replaced, others stay.

    A batch without rejects still replaces: nothing of an earlier attempt is left."""
    place = f"{path.rstrip('/')}/batch={batch}"
    rejected.select(RAW, REJECT_REASON).write.mode("overwrite").option("compression", "snappy").parquet(place)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The stored rejects: ``_raw``, ``_reject_reason``, ``batch``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], REJECTS_SCHEMA)
    return spark.read.schema(REJECTS_SCHEMA).parquet(path)


def replay_rejects(spark: SparkSession, path: str, fix: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame]) -> int:
    """Correct stored rejects and take them in; the number of rows accepted.

    ``fix`` maps the rejects (``_raw``, ``_reject_reason``, ``batch``) to the same
    rows with a corrected ``_raw``.  ``again`` upserts the corrected rows and
    returns those that were rejected once more (``_raw``, ``_reject_reason``,
    ``batch``).  The store then holds only these, swapped in whole: a run that is
    killed in between is repeated without harm, as an upsert is."""
    recover(spark, path)
    rejects = read_rejects(spark, path)
    before = rejects.count()
    if not before:
        return 0
    left = again(fix(rejects).select(RAW, REJECT_REASON, "batch")).select(RAW, REJECT_REASON, "batch")
    write_table(left, path, "batch", mode="overwrite")
    return before - read_rejects(spark, path).agg(F.count(F.lit(1))).first()[0]


__all__ = ["REJECTS_SCHEMA", "store_rejects", "read_rejects", "replay_rejects"]
