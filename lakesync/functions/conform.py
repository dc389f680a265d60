"""Conform rows to a target schema (F2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesync.schema import as_struct

REJECT_REASON = "_reject_reason"
RAW = "_raw"


def conform_tagged(df: DataFrame, schema: T.StructType | str, required: list[str] | None = None,
                   corrupt_col: str | None = None) -> DataFrame:
    """``df`` cast to ``schema``, with ``_reject_reason`` (null for a row that
    fits) and ``_raw``, the row as it came, as a JSON string."""
    target = as_struct(schema)
    have = set(df.columns)
    missing = [f.name for f in target.fields if f.name not in have]
    if missing:
        raise ValueError(f"input lacks target columns: {missing}")
    must = set(required or []) | {f.name for f in target.fields if not f.nullable}

    casted = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in target.fields]
    reasons = []
    if corrupt_col and corrupt_col in have:
        reasons.append(F.when(F.col(corrupt_col).isNotNull(), F.lit("corrupt record")))
    for f, val in zip(target.fields, casted):
        raw = F.col(f"`{f.name}`")
        reasons.append(F.when(raw.isNotNull() & val.isNull(), F.lit(f"bad value: {f.name}")))
        if f.name in must:
            reasons.append(F.when(raw.isNull(), F.lit(f"null required field: {f.name}")))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    if corrupt_col and corrupt_col in have:
        raw = F.coalesce(F.col(corrupt_col), raw)  # the line itself
    return df.select(*casted, reason.alias(REJECT_REASON), raw.alias(RAW))


def conform(df: DataFrame, schema: T.StructType | str, required: list[str] | None = None,
            corrupt_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Order and cast ``df`` to ``schema``; split off rows that do not fit.

    * a target column missing from ``df`` is an error (raised at plan time);
    * every value is cast with ``try_cast``: a non-null input that becomes null
      is a bad value;
    * a null in a non-nullable field, or in any ``required`` field, is a bad row;
    * a row carrying ``corrupt_col`` (unparseable JSON) is a bad row.

    Returns ``(good, rejected)``.  ``good`` has exactly the target schema;
    ``rejected`` keeps the raw row as a JSON string plus ``_reject_reason``.
    Both frames share one plan, so Spark evaluates the casts once per action.
    """
    target = as_struct(schema)
    tagged = conform_tagged(df, target, required, corrupt_col)
    good = tagged.where(F.col(REJECT_REASON).isNull()).select(*[F.col(f"`{f.name}`") for f in target.fields])
    good = good.to(target) if all(f.nullable for f in target.fields) else good
    rejected = tagged.where(F.col(REJECT_REASON).isNotNull()).select(RAW, REJECT_REASON)
    return good, rejected
