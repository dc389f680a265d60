"""Partition and schema drift between storage and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADD, DROP = "ADD", "DROP"


def partition_drift(storage: DataFrame, catalog: DataFrame, col: str = "part") -> DataFrame:
    """Partitions on storage but not in the catalog (``ADD``) and the reverse
    (``DROP``) (C2).

    Both inputs are one-column frames of partition values (duplicates allowed).
    Each side is reduced to distinct values first, so the full outer join moves
    one row per partition, never per data row.
    """
    s = storage.select(F.col(storage.columns[0]).alias("_s")).distinct()
    c = catalog.select(F.col(catalog.columns[0]).alias("_c")).distinct()
    j = s.join(c, s["_s"].eqNullSafe(c["_c"]), "full_outer")
    return (j.where(F.col("_s").isNull() | F.col("_c").isNull())
            .select(F.coalesce("_s", "_c").alias(col),
                    F.when(F.col("_c").isNull(), F.lit(ADD)).otherwise(F.lit(DROP)).alias("action")))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Column-level difference of two ``(col_name, data_type)`` frames:
    ``ADD`` (new column), ``DROP`` (gone) or ``TYPE`` (type changed)."""
    o = old.select(F.lower("col_name").alias("_n"), F.col("data_type").alias("_old"))
    n = new.select(F.lower("col_name").alias("_m"), F.col("data_type").alias("_new"))
    j = o.join(n, o["_n"] == n["_m"], "full_outer")
    action = (F.when(F.col("_n").isNull(), F.lit("ADD"))
              .when(F.col("_m").isNull(), F.lit("DROP"))
              .when(F.lower("_old") != F.lower("_new"), F.lit("TYPE")))
    return (j.select(F.coalesce("_m", "_n").alias("col_name"), "_old", "_new", action.alias("action"))
            .where(F.col("action").isNotNull())
            .withColumnRenamed("_old", "old_type").withColumnRenamed("_new", "new_type"))


def needs_sync(*drifts: DataFrame) -> bool:
    """Conditional sync (C4): true when any drift frame has a row.

    ``isEmpty`` stops at the first row found, so an unchanged table costs one
    short job per drift frame.
    """
    return any(not d.isEmpty() for d in drifts)
