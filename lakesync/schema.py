"""Schema arguments: a ``StructType`` or a DDL string."""

from __future__ import annotations

from pyspark.sql import types as T


def as_struct(schema: T.StructType | str) -> T.StructType:
    """``schema`` as a ``StructType`` (DDL strings are parsed by Spark)."""
    if isinstance(schema, T.StructType):
        return schema
    parsed = T.StructType.fromDDL(schema)
    if not isinstance(parsed, T.StructType):
        raise ValueError(f"not a struct schema: {schema!r}")
    return parsed


def with_string_field(schema: T.StructType, name: str) -> T.StructType:
    """``schema`` plus a nullable string field ``name`` (if missing)."""
    if name in schema.fieldNames():
        return schema
    return T.StructType([*schema.fields, T.StructField(name, T.StringType(), True)])
