"""Size checks behind every broadcast: measured bytes against a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def row_bytes(schema: T.StructType, cols: list[str]) -> Column:
    """Per-row size of ``cols`` as a hashed broadcast row holds them: a fixed
    8-byte word per field plus the bytes of variable-length values."""
    size = F.lit(8)
    for c in cols:
        dt = schema[c].dataType
        if isinstance(dt, (T.StringType, T.BinaryType)):
            size = size + F.lit(8) + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
        elif isinstance(dt, T.DecimalType) and dt.precision > 18:
            size = size + F.lit(24)
        else:
            size = size + F.lit(8)
    return size


def broadcast_bound(spark: SparkSession, override: int | None = None) -> int:
    """Byte bound of a broadcast: ``override`` or the session's
    ``spark.sql.autoBroadcastJoinThreshold`` (<= 0: never broadcast)."""
    if override is not None:
        return int(override)
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB")).strip().lower()
    num = raw.rstrip("kmgtb ")
    unit = raw[len(num):].strip()
    try:
        return int(float(num) * _UNITS.get(unit, 1))
    except ValueError:
        return -1


def measured_bytes(df: DataFrame, cols: list[str]) -> int:
    """Bytes of ``cols`` over all rows of ``df`` (one aggregation job)."""
    return int(df.agg(F.coalesce(F.sum(row_bytes(df.schema, cols)), F.lit(0))).first()[0])
