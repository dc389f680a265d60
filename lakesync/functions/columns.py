"""Scalar column expressions.  All are built-in Spark functions, so they stay
inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values the runner relies on: the time pattern of the ordering field,
# the slash-encoded day of partition values, and the URN layout of a
# registry entry "urn:li:dataset:(urn:li:dataPlatform:<platform>,<db>.<table>,<env>)".
TS_PATTERN = "yyyy-MM-dd HH:mm:ss"
SLASH_DAY_PATTERN = "yyyy/MM/dd"
DASH_DAY_PATTERN = "yyyy-MM-dd"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_ts(col: str | Column, fmt: str = TS_PATTERN, strict: bool = True, ntz: bool = True) -> Column:
    """Parse a time string with a fixed pattern (F1).

    ``strict`` throws on malformed input under ANSI mode (the default in
    Spark 4); lenient mode yields null so the row can be rejected.  ``ntz``
    keeps the value zone-free (``timestamp_ntz``), matching the test tables.
    """
    c, p = _c(col), F.lit(fmt)
    if ntz:
        if strict:
            return F.to_timestamp_ntz(c, p)
        # the zone-free parse runs only where the lenient parse succeeds, so
        # bad input yields null without depending on the session time zone
        return F.when(F.try_to_timestamp(c, p).isNotNull(), F.to_timestamp_ntz(c, p))
    return F.to_timestamp(c, p) if strict else F.try_to_timestamp(c, p)


def record_key(*fields: str) -> Column:
    """Record key from one field (SIMPLE generator) or several.

    Several fields are rendered as ``field:value`` pairs joined by commas; a
    backslash, comma or colon in a value is escaped by a backslash and a null is
    ``\\N``, so different values never give the same key.
    """
    if len(fields) == 1:
        return _c(fields[0]).cast("string")
    def shown(f: str) -> Column:
        return F.coalesce(F.regexp_replace(_c(f).cast("string"), r"([\\,:])", r"\\$1"), F.lit("\\N"))

    return F.concat_ws(",", *[F.concat(F.lit(f + ":"), shown(f)) for f in fields])


def with_record_key(df: DataFrame, *fields: str, name: str = "record_key") -> DataFrame:
    return df.withColumn(name, record_key(*fields))


def partition_path(col: str | Column, name: str, hive_style: bool = True) -> Column:
    """Relative partition directory for a value (F4): ``name=value`` or ``value``.

    DATE values render as ``yyyy-MM-dd``.
    """
    value = _c(col).cast("string")
    return F.concat(F.lit(f"{name}="), value) if hive_style else value


def with_partition_path(df: DataFrame, col: str, name: str | None = None, hive_style: bool = True,
                        out: str = "partition_path") -> DataFrame:
    return df.withColumn(out, partition_path(col, name or col, hive_style))


def partition_value(col: str | Column) -> Column:
    """Partition path or raw value to a typed DATE.

    Accepts ``yyyy/MM/dd`` (slash-encoded day, also with ``%2F`` as in folder names), ``yyyy-MM-dd`` and either
    prefixed by ``name=``; anything else becomes null (and is rejected upstream).
    """
    slashes = F.regexp_replace(_c(col), "%2[Ff]", "/")  # folder names have them escaped
    raw = F.regexp_extract(slashes, r"(?:^|=)(\d{4}[/-]\d{2}[/-]\d{2})$", 1)
    dashed = F.regexp_replace(raw, "/", "-")
    return F.when(raw != "", F.try_to_date(dashed, DASH_DAY_PATTERN))


def parse_urn(col: str | Column) -> Column:
    """Split a dataset URN into ``struct(platform, dataset)``.

    The platform is the last ``:`` part of the first comma item, the dataset
    name is the second comma item.
    """
    parts = F.split(_c(col), ",")
    head = F.element_at(parts, 1)
    platform = F.element_at(F.split(head, ":"), -1)
    dataset = F.when(F.size(parts) >= 2, F.element_at(parts, 2))
    return F.struct(platform.alias("platform"), dataset.alias("dataset"))
