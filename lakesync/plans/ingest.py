"""Ingest-and-publish runs.

* ``run_inline``   (P1): incremental JSON ingest, conform, keep-latest,
  copy-on-write upsert, publish and partition sync -- one call.
* ``run_separate`` (P2): the same in two steps; publication runs only if the
  ingest succeeded.  Both give the same table and catalog state.
* ``run_batch``    (P3): inferred JSON read, parsed time, keep-latest, full
  overwrite, publish.
* ``run_validate`` (P4): audits of catalog and storage for a list of tables,
  folded into one verdict per table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesync.catalog.publish import publish, sync_partitions
from lakesync.functions.columns import TS_PATTERN, parse_ts
from lakesync.functions.conform import RAW, REJECT_REASON, conform, conform_tagged
from lakesync.operators.audits import audit_databases, audit_paths, audit_tables, check_table, verdict
from lakesync.operators.merge import latest_per_key
from lakesync.schema import as_struct
from lakesync.sinks.commit import mark_published, partition_values, recover, unpublished
from lakesync.session import scratch_path
from lakesync.sinks.rejects import read_rejects, replay_rejects
from lakesync.sinks.table import UpsertResult, _outside, check_stored_schema, prepare_batch, upsert_to_path, write_table
from lakesync.sources.catalog_snapshot import catalog_snapshot, database_snapshot
from lakesync.sources.files import storage_listing
from lakesync.sources.json_files import TS_NTZ_FORMAT, read_json, read_json_inferred
from lakesync.spec import TableSpec
from lakesync.streaming.ingest import run_upsert_stream


CORRUPT_COL = "_corrupt_record"


@dataclass
class RunSummary:
    table: str
    batches: list[dict] = field(default_factory=list)
    publish: dict | None = None
    partitions: dict | None = None
    ok: bool = True
    replayed: int = 0  # stored rejects accepted by a replay
    error: str | None = None

    def totals(self) -> dict:
        keys = ("rows_in", "rejected", "superseded", "duplicates", "stale", "inserted", "updated")
        return {k: sum(b.get(k) or 0 for b in self.batches) for k in keys}


def _ordered(good: DataFrame, spec: TableSpec, order_format: str | None, strict: bool) -> DataFrame:
    """A string ordering field becomes ``timestamp_ntz`` in every run, by
    ``order_format`` or the spec's; rows without an ordering value are rejected in every run."""
    fmt = order_format or spec.order_format
    if fmt and isinstance(good.schema[spec.order].dataType, T.StringType):
        good = good.withColumn(spec.order, parse_ts(spec.order, fmt, strict=strict))
    return good.where(F.col(spec.order).isNotNull())


def _validator(target: T.StructType, spec: TableSpec, order_format: str | None,
               strict: bool) -> Callable[[DataFrame], DataFrame]:
    """Conform to ``target``; optionally parse the ordering field so it has
    one time type in every run."""

    def validate(batch: DataFrame) -> DataFrame:
        good, _ = conform(batch, target, required=list(spec.keys) + [spec.order], corrupt_col=CORRUPT_COL)
        return _ordered(good, spec, order_format, strict)

    return validate


def _tagger(target: T.StructType, spec: TableSpec, order_format: str | None, strict: bool) -> Callable[[DataFrame], DataFrame]:
    """As :func:`_validator`, with every row kept and its reason named."""

    def tagged(batch: DataFrame) -> DataFrame:
        rows = conform_tagged(batch, target, required=list(spec.keys) + [spec.order], corrupt_col=CORRUPT_COL)
        fmt = order_format or spec.order_format
        if fmt and isinstance(rows.schema[spec.order].dataType, T.StringType):
            rows = rows.withColumn(spec.order, parse_ts(spec.order, fmt, strict=strict))
        bad = F.when(F.col(spec.order).isNull(), F.lit(f"no ordering value: {spec.order}"))
        return rows.withColumn(REJECT_REASON, F.coalesce(F.col(REJECT_REASON), bad))

    return tagged


def replay(spark: SparkSession, rejects: str, fix: Callable[[DataFrame], DataFrame], schema: T.StructType | str, spec: TableSpec,
           order_format: str | None = None) -> RunSummary:
    """Take corrected rejects of earlier runs into the table and publish it (F2).

    ``fix`` corrects the ``_raw`` text (a JSON object) of stored rejects.  Rows
    that still do not fit stay in the store with their reason of now."""
    summary = RunSummary(spec.qualified_name)
    target = as_struct(schema)

    def again(rows: DataFrame) -> DataFrame:
        whole = T.StructType([*target.fields, T.StructField(CORRUPT_COL, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL, "timestampNTZFormat": TS_NTZ_FORMAT}
        place = scratch_path(spark, "replayed")
        rows.withColumn("row", F.from_json(RAW, whole, options)).write.parquet(place)
        rows = spark.read.parquet(place)
        origin = F.struct(F.col("_text"), F.col("_batch"))
        batches = rows.select("row.*", F.col("batch").alias("_batch"), F.col(RAW).alias("_text")).withColumn(
            CORRUPT_COL, F.when(F.col(CORRUPT_COL).isNotNull(), F.to_json(origin)))
        left = scratch_path(spark, "left")
        res = upsert_to_path(batches, spec, spark, tagged=_tagger(target, spec, order_format, False), exact_counts=True, rejects=left)
        summary.batches.append(res.as_dict())
        known = F.from_json(RAW, "_text string, _batch string")
        return read_rejects(spark, left).select(known["_text"].alias(RAW), REJECT_REASON, known["_batch"].alias("batch"))

    summary.replayed = replay_rejects(spark, rejects, fix, again)
    if summary.batches:
        _publish(spark, spec, stored_schema(spark, target, spec, _validator(target, spec, order_format, False)), summary)
    return summary


def stored_schema(spark: SparkSession, source_schema: T.StructType, spec: TableSpec,
                  validate: Callable[[DataFrame], DataFrame] | None = None) -> T.StructType:
    """Schema of the stored table, derived by planning the ingest steps on an
    empty frame (so the partition column gets the type its expression has)."""
    empty = spark.createDataFrame([], source_schema)
    df = validate(empty) if validate else empty
    return prepare_batch(df, spec)[0].schema


def _ingest(spark: SparkSession, source: str, target: T.StructType, spec: TableSpec,
            checkpoint: str | None, max_files_per_trigger: int | None,
            validate: Callable[[DataFrame], DataFrame], exact_counts: bool,
            max_bytes_per_trigger: str | int | None = None,
            tagged: Callable[[DataFrame], DataFrame] | None = None, rejects: str | None = None) -> list[UpsertResult]:
    ckpt = checkpoint_of(spec, checkpoint)
    return run_upsert_stream(spark, source, target, spec, ckpt, transform=validate, tagged=tagged, rejects=rejects,
                             max_files_per_trigger=max_files_per_trigger, corrupt_col=CORRUPT_COL,
                             exact_counts=exact_counts, max_bytes_per_trigger=max_bytes_per_trigger)


def checkpoint_of(spec: TableSpec, checkpoint: str | None) -> str:
    """The stream checkpoint: beside the table by default, never inside it (a full overwrite would delete it)."""
    ckpt = checkpoint or f"{spec.path.rstrip('/')}.lakesync_checkpoint"
    _outside(ckpt, spec.path, "checkpoint")
    return ckpt


def _publish(spark: SparkSession, spec: TableSpec, schema: T.StructType, summary: RunSummary) -> None:
    """Publish the table and register what the journal records since the last publication.

    Each commit noted the partitions that it rewrote, so a publication that
    was lost, whoever lost it, is made up for without listing the table.  A
    commit never removes a partition, unless it replaced the whole table: then,
    or when the table is new in the catalog, storage is listed and synced whole.
    A versioned table's commits have registered its partitions themselves."""
    recover(spark, spec.path)
    summary.publish = publish(spark, spec, schema)
    records = unpublished(spark, spec.path)
    whole = summary.publish["created"] or not spec.partition or any(r["kind"] == "overwrite" for r in records)
    touched = None if whole else sorted({v for r in records for v in partition_values(r["folders"])})
    summary.partitions = sync_partitions(spark, spec, touched=touched)
    mark_published(spark, spec.path)


def _check_target(spark: SparkSession, spec: TableSpec, schema: T.StructType) -> None:
    """A published table whose columns the run would lose or retype fails before the ingest."""
    if spec.table and spark.catalog.tableExists(spec.qualified_name):
        check_stored_schema(spark, spec, schema)


def _target(schema: T.StructType | str) -> T.StructType:
    return as_struct(schema)


def run_inline(spark: SparkSession, source: str, schema: T.StructType | str, spec: TableSpec,
               checkpoint: str | None = None, max_files_per_trigger: int | None = None,
               order_format: str | None = None, strict: bool = False,
               exact_counts: bool = False, max_bytes_per_trigger: str | int | None = None,
               rejects: str | None = None) -> RunSummary:
    """Ingest new files under ``source`` and publish the table.

    ``order_format`` parses a string ordering field to ``timestamp_ntz``;
    unparseable values are rejected (``strict=False``) or fail the run.
    ``exact_counts`` reports stale rows apart from batch duplicates and takes
    every count from durable files, so that stages run again after a lost
    executor change none.  ``rejects`` is the path of a store that keeps the
    rejected rows by batch, for :func:`replay`.
    ``max_files_per_trigger`` / ``max_bytes_per_trigger`` bound each
    micro-batch of a large backlog.
    """
    summary = RunSummary(spec.qualified_name)
    target = _target(schema)
    validate = _validator(target, spec, order_format, strict)
    _check_target(spark, spec, stored_schema(spark, target, spec, validate))
    results = _ingest(spark, source, target, spec, checkpoint, max_files_per_trigger, validate, exact_counts,
                      max_bytes_per_trigger, _tagger(target, spec, order_format, strict) if exact_counts or rejects else None, rejects)
    summary.batches = [r.as_dict() for r in results]
    _publish(spark, spec, stored_schema(spark, target, spec, validate), summary)
    return summary


def run_separate(spark: SparkSession, source: str, schema: T.StructType | str, spec: TableSpec,
                 checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                 order_format: str | None = None, strict: bool = False,
                 exact_counts: bool = False, max_bytes_per_trigger: str | int | None = None,
               rejects: str | None = None) -> RunSummary:
    """Ingest, then publish in a second step that runs only if the first
    succeeded (P2)."""
    summary = RunSummary(spec.qualified_name)
    target = _target(schema)
    validate = _validator(target, spec, order_format, strict)
    try:
        _check_target(spark, spec, stored_schema(spark, target, spec, validate))
        results = _ingest(spark, source, target, spec, checkpoint, max_files_per_trigger, validate, exact_counts,
                          max_bytes_per_trigger, _tagger(target, spec, order_format, strict) if exact_counts or rejects else None, rejects)
        summary.batches = [r.as_dict() for r in results]
    except Exception as e:  # the publication step must not run after a failed ingest
        summary.ok, summary.error = False, f"ingest failed: {e}"
        return summary
    _publish(spark, spec, stored_schema(spark, target, spec, validate), summary)
    return summary


def run_batch(spark: SparkSession, source: str, spec: TableSpec, ts_col: str | None = None,
              ts_format: str = TS_PATTERN, strict: bool = True, schema: T.StructType | str | None = None) -> RunSummary:
    """JSON read, conform, parsed time, keep-latest, full overwrite, publish.

    The target schema is ``schema``, or that inferred from the whole input, whose
    text is scanned once (:func:`lakesync.sources.read_json_inferred`).
    Malformed lines, bad types, null keys and null ordering values are
    rejected, as in the other runs.  A string time column is parsed to
    ``timestamp_ntz``; with ``strict=False`` unparseable times are rejected
    instead of failing the job.
    """
    if spec.versioned:
        raise ValueError("a full overwrite cannot switch a versioned table")
    summary = RunSummary(spec.qualified_name)
    o_in, o_out = Observation("lakesync_batch_in"), Observation("lakesync_batch_out")
    if schema is None:
        df = read_json_inferred(spark, source, corrupt_col=CORRUPT_COL)
        target = T.StructType([f for f in df.schema.fields if f.name != CORRUPT_COL])
    else:
        target = as_struct(schema)
        df = read_json(spark, source, target, corrupt_col=CORRUPT_COL)
    df = df.observe(o_in, F.count(F.lit(1)).alias("rows"))
    ts = ts_col or spec.order
    good, _ = conform(df, target, required=[c for c in (*spec.keys, spec.order) if c in target.fieldNames()], corrupt_col=CORRUPT_COL)
    if isinstance(good.schema[ts].dataType, T.StringType):
        good = good.withColumn(ts, parse_ts(ts, ts_format, strict=strict)).where(F.col(ts).isNotNull())
    good, _ = prepare_batch(_ordered(good, spec, None, strict), spec)
    good = good.observe(o_out, F.count(F.lit(1)).alias("rows"))
    latest = latest_per_key(good, spec.identity, spec.order, spec.tie)
    write_table(latest, spec.path, spec.partition, mode="overwrite", parallelism=spec.parallelism)
    n_in, n_good = o_in.get["rows"], o_out.get["rows"]
    summary.batches = [{"rows_in": n_in, "rejected": n_in - n_good}]
    _publish(spark, spec, latest.schema, summary)
    return summary


def run_validate(spark: SparkSession, specs: list[TableSpec], mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """Check databases, tables and table paths of ``specs``.

    Returns ``(checks, verdicts)``; a table passes under ``mode="all"`` only
    if every one of its checks passes.
    """
    rows = [(s.database, s.table, s.path, s.qualified_name) for s in specs]
    expected = spark.createDataFrame(rows, "database string, table_name string, path string, target string")
    dbs = {s.database for s in specs}
    db_checks = audit_databases(expected.select("database").distinct(), database_snapshot(spark))
    tbl_checks = audit_tables(expected, catalog_snapshot(spark, sorted(dbs)))
    # existence only: a table's files are never listed to validate its path
    path_checks = audit_paths(expected.select("path").distinct(),
                              storage_listing(spark, [s.path for s in specs], list_files=False), count_files=False)
    # every check row is attributed to its table target
    db_rows = (expected.select("database", F.col("target").alias("_t"))
               .join(db_checks.withColumnRenamed("target", "database"), "database")
               .drop("database").withColumnRenamed("_t", "target"))
    path_rows = (expected.select("path", F.col("target").alias("_t"))
                 .join(path_checks.withColumnRenamed("target", "path"), "path")
                 .drop("path").withColumnRenamed("_t", "target"))
    checks = check_table(db_rows, tbl_checks, path_rows)
    return checks, verdict(checks, "target", mode, targets=expected.select("target"))
