"""Audits of catalog, storage and a metadata registry.

The runner this replaces asked one command-line tool per name.  Here each audit
is one join of an *expected* frame against a *snapshot* frame, so a thousand
targets cost the same plan as one.  Every audit returns check rows::

    target STRING, check_name STRING, success BOOLEAN, message STRING,
    validation_type STRING

Snapshots are reduced to distinct keys before the join (partial aggregation on
the map side); the left join keeps every expected row, so a missing target is a
failed row, never a dropped one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.functions.columns import parse_urn

CHECK_COLUMNS = ["target", "check_name", "success", "message", "validation_type"]


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _check(target: Column, name: str, success: Column, message: Column, vtype: str) -> list[Column]:
    return [target.alias("target"), F.lit(name).alias("check_name"), success.alias("success"),
            message.alias("message"), F.lit(vtype).alias("validation_type")]


def audit_databases(expected: DataFrame, snapshot: DataFrame, db_col: str = "database",
                    validation_type: str = "spark_catalog") -> DataFrame:
    """Does every expected database exist in the snapshot? (V1)"""
    present = snapshot.select(F.lower(db_col).alias("_db")).distinct().withColumn("_hit", F.lit(True))
    j = expected.join(present, F.lower(expected[db_col]) == present["_db"], "left")
    db = F.col(db_col)
    ok = ~_blank(db) & F.col("_hit").isNotNull()
    msg = (F.when(_blank(db), F.lit("no database given"))
           .when(ok, F.format_string("database %s is in the catalog", db))
           .otherwise(F.format_string("database %s is missing from the catalog", db)))
    return j.select(*_check(F.coalesce(db, F.lit("")), "database", ok, msg, validation_type))


def audit_tables(expected: DataFrame, snapshot: DataFrame, db_col: str = "database",
                 table_col: str = "table_name", validation_type: str = "spark_catalog") -> DataFrame:
    """Does every expected (database, table) exist in the snapshot? (V2)

    Names compare case-insensitively, as catalog identifiers do.
    """
    present = (snapshot.select(F.lower(F.col(db_col)).alias("_db"), F.lower(F.col(table_col)).alias("_t"))
               .distinct().withColumn("_hit", F.lit(True)))
    j = expected.join(present, (F.lower(expected[db_col]) == present["_db"])
                      & (F.lower(expected[table_col]) == present["_t"]), "left")
    db, t = F.col(db_col), F.col(table_col)
    blank = _blank(db) | _blank(t)
    ok = ~blank & F.col("_hit").isNotNull()
    target = F.concat_ws(".", db, t)
    msg = (F.when(blank, F.lit("no database or table given"))
           .when(ok, F.format_string("table %s.%s is listed under %s", db, t, db))
           .otherwise(F.format_string("table %s.%s is not listed under %s", db, t, db)))
    return j.select(*_check(target, "database_table", ok, msg, validation_type))


def audit_paths(expected: DataFrame, listing: DataFrame, path_col: str = "path",
                validation_type: str = "table_path", count_files: bool = True) -> DataFrame:
    """Does every expected table path exist on storage? (V3)

    ``listing`` is the frame of :func:`lakesync.sources.files.storage_listing`:
    one row per file plus one marker row per root (``root, path, length,
    root_exists``).  Files are counted per root before the join.  With
    ``count_files=False`` (a listing of markers only) the message leaves the
    file count out.
    """
    per_root = (listing.groupBy("root")
                .agg(F.bool_or("root_exists").alias("_exists"),
                     F.count("path").alias("_files")))
    j = expected.join(per_root, expected[path_col] == per_root["root"], "left")
    p = F.col(path_col)
    ok = ~_blank(p) & F.coalesce(F.col("_exists"), F.lit(False))
    msg = (F.when(_blank(p), F.lit("path is empty"))
           .when(ok, F.format_string("path %s is there with %d files", p, F.col("_files")) if count_files
                 else F.format_string("path %s is there", p))
           .otherwise(F.format_string("path %s is missing", p)))
    return j.select(*_check(F.coalesce(p, F.lit("")), "table_path", ok, msg, validation_type))


def find_dataset(registry: DataFrame, database: str, table: str, platform: str,
                 entity_col: str = "entity") -> DataFrame:
    """Registry entries for one ``database.table`` on one platform."""
    u = registry.withColumn("_urn", parse_urn(entity_col))
    return (u.where((F.col("_urn.platform") == platform) & (F.col("_urn.dataset") == f"{database}.{table}"))
            .drop("_urn"))


def audit_datasets(expected: DataFrame, registry: DataFrame, platform: str | None = None,
                   db_col: str = "database", table_col: str = "table_name", platform_col: str = "platform",
                   entity_col: str = "entity", validation_type: str = "registry_dataset") -> DataFrame:
    """Is every expected dataset present in a registry export? (V4)

    The registry is one URN per row; it is parsed (F6), reduced to distinct
    (platform, dataset) and left-joined with the expected rows.  ``platform``
    fixes one platform for every expected row when it has no platform column.
    """
    urn = parse_urn(entity_col)
    present = (registry.select(urn.platform.alias("_p"), urn.dataset.alias("_d"))
               .distinct().withColumn("_hit", F.lit(True)))
    plat = F.lit(platform) if platform is not None else F.col(platform_col)
    exp = expected.withColumn("_want_p", plat).withColumn("_want_d", F.concat_ws(".", db_col, table_col))
    j = exp.join(present, (exp["_want_p"] == present["_p"]) & (exp["_want_d"] == present["_d"]), "left")
    blank = _blank(F.col(table_col))
    ok = ~blank & F.col("_hit").isNotNull()
    msg = (F.when(blank, F.lit("no table given"))
           .when(ok, F.format_string("registry lists %s", F.col("_want_d")))
           .otherwise(F.format_string("registry lacks %s", F.col("_want_d"))))
    return j.select(*_check(F.col("_want_d"), "registry_dataset", ok, msg, validation_type))


def check_table(*audits: DataFrame) -> DataFrame:
    """All check rows of all audits in one frame (V5)."""
    if not audits:
        raise ValueError("no audits given")
    out = audits[0].select(*CHECK_COLUMNS)
    for a in audits[1:]:
        out = out.unionByName(a.select(*CHECK_COLUMNS))
    return out


def verdict(checks: DataFrame, by: str | list[str] = "target", mode: str = "all",
            targets: DataFrame | None = None) -> DataFrame:
    """Pass/fail per target over all its checks (V6).

    ``mode="all"`` (default) passes a target only if every check passes;
    ``mode="any"`` passes it if one check does.  With ``targets``, a target that
    has no check row at all is reported and fails.
    """
    keys = [by] if isinstance(by, str) else list(by)
    fold = F.bool_and if mode == "all" else F.bool_or
    if mode not in ("all", "any"):
        raise ValueError("mode must be 'all' or 'any'")
    agg = checks.groupBy(*keys).agg(fold("success").alias("success"),
                                    F.count(F.lit(1)).alias("n_checks"),
                                    F.count_if(~F.col("success")).alias("n_failed"))
    if targets is None:
        return agg
    return (targets.select(*keys).distinct().join(agg, keys, "left")
            .select(*keys, F.coalesce("success", F.lit(False)).alias("success"),
                    F.coalesce("n_checks", F.lit(0)).alias("n_checks"),
                    F.coalesce("n_failed", F.lit(0)).alias("n_failed")))
