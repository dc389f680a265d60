"""Catalog snapshots as rows (S5): the input of the catalog audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog_snapshot(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """``(database, table_name, is_temporary)`` for the given databases (all when
    ``None``).  Databases that do not exist contribute no rows."""
    all_dbs = [r[0] for r in spark.sql("SHOW DATABASES").collect()]
    names = databases if databases is not None else all_dbs
    existing = {d.lower() for d in all_dbs}
    frames = [spark.sql(f"SHOW TABLES IN `{db}`")
              .select(F.lit(db).alias("database"), F.col("tableName").alias("table_name"),
                      F.col("isTemporary").alias("is_temporary"))
              for db in names if db.lower() in existing]
    if not frames:
        return spark.createDataFrame([], "database string, table_name string, is_temporary boolean")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where(~F.col("is_temporary"))


def database_snapshot(spark: SparkSession) -> DataFrame:
    """``(database)`` for every database of the session catalog."""
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("database"))
