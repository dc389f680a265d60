"""Publish a keyed table to the Spark catalog and keep its partitions in step.

Everything goes through SQL DDL of the session catalog, so the same code
serves the in-memory catalog of tests and a shared metastore on a cluster.
New partitions are registered with ``MSCK REPAIR TABLE ... ADD PARTITIONS``,
which Spark runs with a distributed listing when the table has many partition
folders; partitions gone from storage are dropped by value.
"""

from __future__ import annotations

import json
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesync.operators.drift import partition_drift, schema_drift
from lakesync.sources.files import storage_partitions
from lakesync.spec import TableSpec

# Fixed value: catalogs cut long schema strings into parts of this many
# characters (the registry sync default).
SCHEMA_STRING_THRESHOLD = 4000

# up to this many touched partitions are checked one by one against the
# catalog; above it the table's partition list is fetched once instead
PER_VALUE_LOOKUPS = 64


def _q(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def _ddl_columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def table_columns(spark: SparkSession, name: str) -> DataFrame:
    """``(col_name, data_type, is_partition, position)`` of a catalog table."""
    parts = {c.name for c in spark.catalog.listColumns(name) if c.isPartition}
    schema = spark.table(name).schema
    rows = [(f.name, f.dataType.simpleString(), f.name in parts, i) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, "col_name string, data_type string, is_partition boolean, position bigint")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# what a spec holds besides its place, its name and the fields that have a property of their own
_SPEC_FIELDS = ("keys", "tie", "partition_expr", "parallelism", "max_pruned_partitions", "broadcast_bytes", "order_format", "versioned", "key_buckets")


def spec_properties(spec: TableSpec) -> dict[str, str]:
    """A spec as table properties; :func:`described_spec` reads them back.

    A partition expression that is a function cannot be written down and is left out."""
    more = {f: getattr(spec, f) for f in _SPEC_FIELDS}
    if callable(more["partition_expr"]):
        more["partition_expr"] = None
    return {"lakesync.record_key": ",".join(spec.keys), "lakesync.ordering": spec.order, "lakesync.partition": spec.partition or "",
            "lakesync.tie": ",".join(spec.tie), "lakesync.spec": json.dumps(more)}


def described_spec(description: DataFrame, name: str, path: str) -> tuple[TableSpec, T.StructType]:
    """The spec and schema of a table from its description (:func:`describe_dataset`), the inverse of publishing it.

    Properties give the spec, schema parts the schema; partition columns are
    checked against the description's own rows."""
    rows = description.where(F.col("kind").isin("property", "schema_part", "partition_column")).collect()
    props = {r.name: r.value for r in rows if r.kind == "property"}
    if "lakesync.ordering" not in props:
        raise ValueError(f"{name} was not published with a spec")
    parts = sorted((r for r in rows if r.kind == "schema_part"), key=lambda r: r.position)
    schema = T.StructType.fromJson(json.loads("".join(r.value for r in parts)))
    more = json.loads(props.get("lakesync.spec", "{}"))
    more = {k: tuple(v) if k in ("keys", "tie") else v for k, v in more.items()}
    more.setdefault("keys", tuple(props["lakesync.record_key"].split(",")))
    database, _, table = name.rpartition(".")
    spec = TableSpec(path=path, order=props["lakesync.ordering"], partition=props["lakesync.partition"] or None, database=database, table=table, **more)
    if [r.name for r in rows if r.kind == "partition_column"] != ([spec.partition] if spec.partition else []):
        raise ValueError(f"{name}: the partition columns are not those of its spec")
    return spec, schema


def read_spec(spark: SparkSession, name: str) -> tuple[TableSpec, T.StructType]:
    """The spec and schema that a published table was given."""
    place = [r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_q(name)}").collect() if r.col_name == "Location"]
    path = place[0]
    return described_spec(describe_dataset(spark, name), name, path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def publish(spark: SparkSession, spec: TableSpec, schema: T.StructType) -> dict:
    """Register the table at ``spec.path`` (C1): create database and table if
    missing, add new columns if the stored schema grew.  Returns what changed.

    Properties record the key, ordering and partition fields so a later reader
    can rebuild the :class:`TableSpec`.
    """
    name = spec.qualified_name
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{spec.database}`")
    created = False
    if not spark.catalog.tableExists(f"{spec.database}.{spec.table}"):
        tbl_props = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in spec_properties(spec).items())
        part = f"PARTITIONED BY (`{spec.partition}`)" if spec.partition else ""
        path = spec.path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {_q(name)} ({_ddl_columns(schema)}) USING parquet {part} "
                  f"LOCATION '{path}' TBLPROPERTIES ({tbl_props})")
        created = True
        added = []
    else:
        # another session (a stream's batch) may have added columns
        spark.catalog.refreshTable(name)
        old = table_columns(spark, name).select("col_name", "data_type")
        new = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema.fields],
                                    "col_name string, data_type string")
        drift = schema_drift(old, new)
        added = [r.col_name for r in drift.where(F.col("action") == "ADD").collect()]
        changed = drift.where(F.col("action") != "ADD").count()
        if changed:
            raise ValueError(f"schema of {name} changed incompatibly; see schema_drift()")
        if added:
            types = {f.name: f.dataType.simpleString() for f in schema.fields}
            cols = ", ".join(f"`{c}` {types[c]}" for c in added)
            spark.sql(f"ALTER TABLE {_q(name)} ADD COLUMNS ({cols})")
    return {"table": name, "created": created, "added_columns": added}


def catalog_partitions(spark: SparkSession, name: str, partition: str) -> DataFrame:
    """Partition values registered in the catalog for ``name`` (as strings)."""
    return (spark.sql(f"SHOW PARTITIONS {_q(name)}")
            # path escapes only: a plus sign stands for itself
            .select(F.url_decode(F.replace(F.regexp_extract("partition", rf"(?:^|/){partition}=([^/]*)", 1), F.lit("+"), F.lit("%2B"))).alias(partition)))


def _partition_specs(p: str, values: list) -> str:
    return " ".join(f"PARTITION (`{p}` = '{str(v).replace(chr(39), chr(92) + chr(39))}')" for v in values)


def sync_partitions(spark: SparkSession, spec: TableSpec, condition: bool = True,
                    touched: list | None = None, batch: int = 500) -> dict:
    """Bring catalog partitions in line with storage (C3); storage is the truth.

    Full sync (default): partition folders under the table root (one
    listing of the root, see
    :func:`lakesync.sources.files.storage_partitions`) without a catalog
    entry are added with ``ALTER TABLE ... ADD IF NOT EXISTS``; catalog
    partitions without a folder are dropped with ``ALTER TABLE ... DROP
    PARTITION`` in groups of ``batch``.  Only partition values --
    catalog metadata, one row per partition -- reach the driver.  Dropping a
    partition of an external table leaves files alone.

    Incremental sync: with ``touched`` (the partition values an upsert just
    rewrote, see ``UpsertResult.touched``) only those are registered with
    ``ADD IF NOT EXISTS``; storage is not listed at all, and for up to
    ``PER_VALUE_LOOKUPS`` values neither is the catalog's partition list, so
    the cost does not grow with the table.  An upsert never removes a partition, so nothing
    needs dropping.

    With ``condition`` (C4) nothing is changed when storage and catalog already
    agree.  Returns the number of partitions added and dropped.
    """
    name = spec.qualified_name
    if not spec.partition or spec.versioned:  # the commits of a versioned table register its partitions
        spark.sql(f"REFRESH TABLE {_q(name)}")
        return {"ADD": 0, "DROP": 0}
    p = spec.partition
    if touched is not None:
        if len(touched) <= PER_VALUE_LOOKUPS:
            # a few touched values: one filtered catalog lookup each, so the
            # table's partition list is never fetched
            new = [str(v) for v in touched
                   if not spark.sql(f"SHOW PARTITIONS {_q(name)} {_partition_specs(p, [v])}").take(1)]
        else:
            known = catalog_partitions(spark, name, p)
            want = spark.createDataFrame([(str(v),) for v in touched], f"{p} string")
            new = [r[0] for r in want.join(known, p, "left_anti").collect()]
        for i in range(0, len(new), batch):
            spark.sql(f"ALTER TABLE {_q(name)} ADD IF NOT EXISTS {_partition_specs(p, new[i:i + batch])}")
        spark.sql(f"REFRESH TABLE {_q(name)}")
        return {"ADD": len(new), "DROP": 0}
    drift = partition_drift(storage_partitions(spark, spec.path, p), catalog_partitions(spark, name, p), p)
    counts = {r["action"]: r["n"] for r in drift.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    if condition and not counts:
        return {"ADD": 0, "DROP": 0}
    for action, verb, joint in (("DROP", "DROP IF EXISTS", ", "), ("ADD", "ADD IF NOT EXISTS", " ")):
        # values come in groups, a group at a time on the driver
        values = (r[0] for r in drift.where(F.col("action") == action).select(p).toLocalIterator()) if counts.get(action) else iter(())
        while group := list(islice(values, batch)):
            specs = joint.join(_partition_specs(p, [v]) for v in group)
            spark.sql(f"ALTER TABLE {_q(name)} {verb} {specs}")
    spark.sql(f"REFRESH TABLE {_q(name)}")
    return {"ADD": counts.get("ADD", 0), "DROP": counts.get("DROP", 0)}


def describe_dataset(spark: SparkSession, name: str, threshold: int = SCHEMA_STRING_THRESHOLD) -> DataFrame:
    """A table described as rows (C5): ``kind, name, value, position``.

    kinds: ``column`` (value = type), ``partition_column``, ``property`` and
    ``schema_part`` -- the JSON schema cut into ``threshold``-character parts
    the way catalogs store long schema strings.
    """
    col_rows = table_columns(spark, name).select(
        F.when(F.col("is_partition"), F.lit("partition_column")).otherwise(F.lit("column")).alias("kind"),
        F.col("col_name").alias("name"), F.col("data_type").alias("value"), F.col("position"))
    props = (spark.sql(f"SHOW TBLPROPERTIES {_q(name)}")
             .select(F.lit("property").alias("kind"), F.col("key").alias("name"), F.col("value"),
                     F.lit(None).cast("bigint").alias("position")))
    schema_json = spark.table(name).schema.json()
    parts = (spark.createDataFrame([(schema_json,)], "s string")
             .selectExpr(f"explode(sequence(0, greatest(0, ceil(length(s) / {threshold}) - 1))) AS i", "s")
             .selectExpr("'schema_part' AS kind", "format_string('schema.part.%d', i) AS name",
                         f"substring(s, i * {threshold} + 1, {threshold}) AS value", "CAST(i AS BIGINT) AS position"))
    return col_rows.unionByName(props).unionByName(parts)
