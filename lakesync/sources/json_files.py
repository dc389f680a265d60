"""JSON directory scans (S1 declared schema, S2 inferred).

An inferred read scans the text once: every line is parsed to a ``VARIANT``, the
variants are written to the shared folder, and both the schema and the columns
come from them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesync.schema import as_struct, with_string_field
from lakesync.session import scratch_path

# Fixed value: zone-free timestamps are written and read with six fraction
# digits; the JSON default keeps only milliseconds and would change the value.
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
              corrupt_col: str | None = None) -> DataFrame:
    """Scan JSON lines.

    With ``schema`` (S1) no inference pass runs; malformed values become null
    (PERMISSIVE) and, if ``corrupt_col`` is given, the raw line is kept there so
    :func:`lakesync.functions.conform` can reject it.  Without a schema Spark
    infers one by an extra pass over the whole input;
    :func:`read_json_inferred` (S2) scans the text once.
    """
    r = spark.read.option("mode", "PERMISSIVE").option("timestampNTZFormat", TS_NTZ_FORMAT)
    if schema is not None:
        if corrupt_col:
            schema = with_string_field(as_struct(schema), corrupt_col)
            r = r.option("columnNameOfCorruptRecord", corrupt_col)
        r = r.schema(schema)
    return r.json(path)


def _settled(dt: T.DataType) -> T.DataType:
    """The column type of a variant type: mixed and unknown types are text, exact numbers long or double."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in dt.fields]) if dt.fields else T.StringType()
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_settled(dt.elementType))
    if isinstance(dt, T.DecimalType):
        return T.LongType() if dt.scale == 0 and dt.precision <= 18 else T.DoubleType()
    return T.StringType() if isinstance(dt, (T.VariantType, T.NullType)) else dt


def variant_schema(described: str) -> T.StructType:
    """The columns of what ``schema_of_variant_agg`` found; no columns unless it is an object."""
    if not described.startswith("OBJECT<") or described == "OBJECT<>":
        return T.StructType([])
    found = T.DataType.fromDDL(re.sub(r"(^|: |ARRAY<)OBJECT<", r"\1STRUCT<", described))
    return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in found.fields])


def _member(variant: str, field: T.StructField) -> Column:
    mark = '"' if "'" in field.name else "'"
    if mark in field.name:
        raise ValueError(f"field name {field.name!r} holds both kinds of quotes")
    return F.try_variant_get(variant, f"$[{mark}{field.name}{mark}]", field.dataType.simpleString())


def read_json_inferred(spark: SparkSession, path: str | list[str], corrupt_col: str | None = None) -> DataFrame:
    """JSON lines with the columns that they have (S2), by one scan of the text.

    A field of several types is text; whole numbers are long, others double;
    columns are in the order of their names.  Lines that hold no JSON object are
    dropped, or kept with their text in ``corrupt_col``.  The parsed lines are
    written to the shared folder, so the source is read once, whatever is done
    with the result."""
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("v"), "value")
    whole = F.schema_of_variant("v").startswith("OBJECT<")
    place = scratch_path(spark, "variants")
    (parsed.select(F.when(whole, F.col("v")).alias("v"), F.when(~F.coalesce(whole, F.lit(False)), F.col("value")).alias("corrupt"))
     .write.option("compression", "zstd").parquet(place))
    lines = spark.read.schema("v variant, corrupt string").parquet(place)
    described = lines.where("v is not null").agg(F.schema_of_variant_agg("v")).first()[0]
    fields = variant_schema(described or "").fields
    cols = [_member("v", f).alias(f.name) for f in fields]
    if corrupt_col:
        return lines.select(*cols, F.col("corrupt").alias(corrupt_col))
    return lines.where("v is not null").select(*cols)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write JSON lines that :func:`read_json` reads back value-exactly."""
    df.write.mode(mode).option("timestampNTZFormat", TS_NTZ_FORMAT).json(path)
