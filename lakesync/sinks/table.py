"""Partitioned Parquet tables written copy-on-write.

``upsert_to_path`` rewrites only the partitions a batch touches:

1. the batch gets its partition column; rows with a null key or partition are
   split off (rejected, never written);
2. the good rows are reduced to one row per identity (top-1 per identity on
   the map side, one shuffle of the batch) and written once to a folder of
   the shared ``spark.checkpoint.dir``.  Every later step reads these files,
   so the source (JSON parse, conform) runs once, the lineage is cut, and the
   size of the batch is *measured*, not guessed;
3. only the touched partitions of the stored table are listed and read
   (their folders are addressed directly for date and integer partition
   values; otherwise a partition filter prunes the scan);
4. the merge strategy follows measured sizes:

   * **broadcast merge** (the batch's identity and ordering columns within
     ``spec.broadcast_bytes``, by default the session's
     ``spark.sql.autoBroadcastJoinThreshold``, and the touched stored folders
     holding at least ``STORED_TO_BATCH_RATIO`` times the batch's bytes on
     disk): the stored ordering values of the batch's identities are found
     by a broadcast semi-join, the winning batch rows by a broadcast left
     join, and the stored rows they replace drop out by a broadcast
     anti-join.  Stored rows are scanned and written back by the task that
     read them -- they are never shuffled.  Only the winning batch rows are
     rebalanced by partition value;
   * **shuffle merge** (larger batches, or a stored side not much larger
     than the batch): stored and batch rows meet in one shuffle by identity
     (keep-latest with the source as first tie-breaker), then a rebalance by
     partition value lays out the files (AQE splits a hot partition over
     several tasks and packs small ones);

5. the result is written once, to a staging folder beside the table, and put in
   place by :mod:`lakesync.sinks.commit`: by renaming the folders of the touched
   partitions, or, for a ``versioned`` table, by switching the locations of the
   catalog's partitions.  The commit is recorded, with the table's schema, and
   can be finished from any point.

Counts for the run summary come from ``DataFrame.observe`` metrics collected
during the batch and merge writes; no extra pass is made for them.
"""

from __future__ import annotations

import logging
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesync.functions.conform import RAW, REJECT_REASON
from lakesync.operators.merge import SRC_COL, latest_per_key
from lakesync.operators.sizing import broadcast_bound, measured_bytes, row_bytes
from lakesync.session import content_bytes, existing_paths, path_exists, remove_path, same_store, scratch_path
from lakesync.sinks.commit import DEFAULT_PARTITION, commit, meta_path, next_number, recorded_schema, recover, version_path
from lakesync.spec import TableSpec

_UPDATED = "_lakesync_updated"
log = logging.getLogger("lakesync")


def _key(partitions: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{p}`").cast("string").alias(f"p{i}") for i, p in enumerate(partitions)]), {"ignoreNullFields": "false"})


def _shares(df: DataFrame, partitions: list[str], parallelism: int | None) -> dict[str, int]:
    """How many of ``parallelism`` tasks a partition gets that holds more than a task's share of the rows.

    One count by the partition columns; at most ``parallelism`` partitions can be that large."""
    if not parallelism or not partitions:
        return {}
    counts = df.select(_key(partitions).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        share = max(1, -(-total // parallelism))
        return {r.k: -(-r.n // share) for r in counts.where(F.col("n") > share).collect()}
    finally:
        counts.unpersist()


def _layout(df: DataFrame, partitions: list[str], parallelism: int | None, shares: dict[str, int] | None = None) -> DataFrame:
    """Lay rows out by the partition columns before a write.

    Without ``parallelism`` a rebalance: rows of one partition value land in
    few tasks while AQE splits a hot one and packs small ones.  With it,
    exactly that many tasks write (AQE does not merge them): a partition goes to
    one task, or to as many as ``shares`` says, dealt by a hash of the row;
    without a partition the hash alone deals."""
    if not parallelism:
        return df.hint("rebalance", *partitions)
    plain = [f.name for f in df.schema.fields if f.name not in partitions and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0)
    if not partitions:
        return df.repartition(parallelism, F.pmod(row, F.lit(1 << 20)))
    if not shares:
        return df.repartition(parallelism, *partitions)
    tasks = F.try_element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), _key(partitions))
    return df.repartition(parallelism, *partitions, F.pmod(row, F.coalesce(tasks, F.lit(1))))


def write_table(df: DataFrame, path: str, partition_by: str | list[str] | None = None, mode: str = "error",
                parallelism: int | None = None, dynamic: bool = False) -> None:
    """Hive-style partitioned Parquet, snappy.

    ``mode="overwrite"`` is a full overwrite (W2) unless ``dynamic``: the new
    content is written beside the table and swapped in whole, so a run that is
    killed leaves the old rows, and ``df`` may read the table it replaces.
    ``parallelism`` sets the number of write tasks (W4), otherwise AQE sizes
    them."""
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    out = _layout(df, parts, parallelism, _shares(df, parts, parallelism)) if parts or parallelism else df
    if mode == "overwrite" and not dynamic:
        spark = df.sparkSession
        recover(spark, path)
        staged = _fresh_stage(path)
        _write(out, staged, parts)
        commit(spark, TableSpec(path=path, keys=(), order="", partition=parts[0] if parts else None), staged, df.schema, "overwrite")
        return
    w = out.write.mode(mode).option("compression", "snappy")
    if parts:
        w = w.partitionBy(*parts)
    # stated on the writer, so the session default cannot turn a full
    # overwrite into a partition overwrite or the reverse
    w = w.option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    w.parquet(path)


def _fresh_stage(path: str) -> str:
    """A staging folder beside the table: putting its content in place moves no bytes."""
    return meta_path(path, "stage", uuid.uuid4().hex)


def prepare_batch(batch: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Add the partition column and split off rows whose key or partition is
    null.  Returns ``(good, rejected)``; ``rejected`` has ``_reject_reason``."""
    tagged = prepare_tagged(batch, spec)
    good = tagged.where(F.col(REJECT_REASON).isNull()).drop(REJECT_REASON)
    return good, tagged.where(F.col(REJECT_REASON).isNotNull())


def prepare_tagged(batch: DataFrame, spec: TableSpec) -> DataFrame:
    """``batch`` with the partition column and ``_reject_reason`` (an earlier reason stays)."""
    df = batch
    if spec.partition and (spec.partition_expr is not None or spec.partition not in df.columns):
        df = df.withColumn(spec.partition, spec.partition_column())
    checks = [F.when(F.col(k).isNull(), F.lit(f"null key: {k}")) for k in spec.keys]
    if spec.partition:
        checks.append(F.when(F.col(spec.partition).isNull(), F.lit(f"null partition: {spec.partition}")))
        if isinstance(df.schema[spec.partition].dataType, T.StringType):
            # both are stored as the default partition and read back as null
            checks.append(F.when(F.col(spec.partition).isin("", DEFAULT_PARTITION), F.lit(f"unusable partition: {spec.partition}")))
    earlier = [F.col(REJECT_REASON)] if REJECT_REASON in df.columns else []
    return df.withColumn(REJECT_REASON, F.coalesce(*earlier, *checks))


@dataclass
class UpsertResult:
    path: str
    rows_in: int = 0
    rejected: int = 0
    superseded: int = 0  # good incoming rows that did not win (duplicates + stale)
    duplicates: int | None = None  # beaten by a newer row of the same batch (exact_counts)
    stale: int | None = None  # beaten by the stored row (exact_counts)
    inserted: int = 0
    updated: int = 0
    stored_read: int = 0
    partitions: int | None = None
    pruned: bool = False
    created: bool = False  # the batch created the table
    touched: list | None = None  # partition values rewritten, when known (pruned upserts)
    staged: str | None = None  # set while a staged result awaits its commit
    strategy: str | None = None  # create, broadcast or shuffle merge
    batch_bytes: int | None = None  # measured bytes of the batch's identity and ordering columns
    extra: dict = field(default_factory=dict)

    def as_dict(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("extra", "touched")} | self.extra


def _table_exists(spark: SparkSession, spec: TableSpec) -> bool:
    """One metadata call; the table's files are not listed."""
    return path_exists(spark, spec.path)


def _incoming(batch: DataFrame, spec: TableSpec, obs: dict | None,
              validate: Callable[[DataFrame], DataFrame] | None = None, dedupe: bool = True) -> DataFrame:
    """Batch with partition column and good rows only; with ``dedupe`` also
    reduced to one row per identity.  With ``obs`` the deduplicated rows are
    also measured: ``bytes`` of their identity and ordering columns."""
    if obs is not None:
        obs["in"] = Observation("lakesync_in")
        batch = batch.observe(obs["in"], F.count(F.lit(1)).alias("rows"))
    if validate is not None:
        batch = validate(batch)
    good, _ = prepare_batch(batch, spec)
    if obs is not None:
        obs["good"] = Observation("lakesync_good")
        good = good.observe(obs["good"], F.count(F.lit(1)).alias("rows"))
    if not dedupe:
        return good
    deduped = latest_per_key(good, spec.identity, spec.order, spec.tie)
    if obs is not None:
        obs["dedup"] = Observation("lakesync_dedup")
        size = row_bytes(deduped.schema, [*spec.identity, spec.order])
        deduped = deduped.observe(obs["dedup"], F.count(F.lit(1)).alias("rows"),
                                  F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
    return deduped


def choose_strategy(spark: SparkSession, spec: TableSpec, batch_bytes: int, strategy: str = "auto") -> str:
    """``broadcast`` when the measured batch fits the bound, else ``shuffle``.

    ``strategy="broadcast"`` skips the comparison with the stored bytes, never the bound."""
    if strategy == "shuffle":
        return strategy
    if strategy not in ("auto", "broadcast"):
        raise ValueError("strategy must be 'auto', 'broadcast' or 'shuffle'")
    bound = broadcast_bound(spark, spec.broadcast_bytes)
    return "broadcast" if 0 < batch_bytes <= bound else "shuffle"


# partition types whose folder name is the plain string of the value, so a
# touched partition can be addressed directly without path escaping
_DIRECT_TYPES = (T.DateType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _read_stored(spark: SparkSession, spec: TableSpec, schema: T.StructType, incoming: DataFrame,
                 res: UpsertResult) -> tuple[DataFrame, list[str] | None]:
    """The stored rows of the partitions the batch touches.

    At most ``max_pruned_partitions + 1`` partition values (not rows) reach
    the driver.  Within that bound, and when partition folders are named by
    the plain value (dates, integers), only the touched folders are listed
    and read, after an existence check that skips folders that do not exist
    yet (see :func:`lakesync.session.existing_paths`), so the cost follows
    the batch, not the table.  Other value
    types list the table and keep the touched partitions with a partition
    filter.  Beyond the bound the stored side is filtered by a semi-join on
    the partition column.  Also returns the folders read, when known.
    """
    part = spec.partition
    if not part:
        return spark.read.schema(schema).parquet(spec.path), [spec.path]
    if spec.versioned:
        whole = _catalog_rows(spark, spec, schema)
    cap = spec.max_pruned_partitions
    vals = [r[0] for r in incoming.select(part).distinct().limit(cap + 1).collect()]
    if len(vals) > cap:
        whole = whole if spec.versioned else spark.read.schema(schema).parquet(spec.path)
        return whole.join(incoming.select(part).distinct(), part, "left_semi"), None
    res.pruned, res.partitions, res.touched = True, len(vals), vals
    if spec.versioned:
        return (whole.where(F.col(part).isin(vals)) if vals else whole.limit(0)), None
    if isinstance(schema[part].dataType, _DIRECT_TYPES):
        root = spec.path.rstrip("/")
        dirs = [f"{root}/{part}={v}" for v in vals]
        found = existing_paths(spark, dirs)
        present = [d for d in dirs if found[d]]
        if not present:
            return spark.createDataFrame([], schema), []
        stored = spark.read.option("basePath", root).schema(schema).parquet(*present)
    else:
        stored, present = spark.read.schema(schema).parquet(spec.path), None
    return (stored.where(F.col(part).isin(vals)) if vals else stored.limit(0)), present


def _catalog_rows(spark: SparkSession, spec: TableSpec, schema: T.StructType) -> DataFrame:
    """The rows of a versioned table, read where the catalog's partitions point, with the columns of ``schema``."""
    spark.catalog.refreshTable(spec.qualified_name)
    table = spark.table(spec.qualified_name)
    have = set(table.columns)
    return table.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


# the broadcast merge pays off when the stored rows it keeps out of a shuffle
# outweigh the batch it broadcasts; below this ratio of on-disk bytes the
# shuffle merge (fewer jobs, nothing broadcast) is the cheaper one
STORED_TO_BATCH_RATIO = 4


def _stored_outweighs(spark: SparkSession, dirs: list[str] | None, batch_dir: str) -> bool:
    """True when the stored folders hold at least ``STORED_TO_BATCH_RATIO``
    times the batch's bytes.  One metadata call per folder, stopping as soon
    as the answer is known; unknown folders count as large."""
    if dirs is None:
        return True
    need = STORED_TO_BATCH_RATIO * content_bytes(spark, batch_dir)
    total = 0
    for d in dirs:
        total += content_bytes(spark, d)
        if total >= need:
            return True
    return False


def _merge(incoming: DataFrame, stored: DataFrame, spec: TableSpec, strategy: str,
           obs: dict | None, winners_dir: str | None = None, shares: dict[str, int] | None = None) -> DataFrame:
    """Stored rows of the touched partitions merged with the (deduplicated)
    batch, laid out for the write; ``_src`` is 1 where the batch row won.

    One rule in both strategies: a batch row that wins replaces all stored
    rows of its identity; a batch row that loses changes nothing.  Stored rows
    of other identities stay as they are, repeated ones and those with a null
    key included.

    With ``winners_dir`` the broadcast merge first writes the winning batch
    rows there (as small as the batch), so the stored identity scan that
    finds them runs once, not once per use of the winners."""
    ids = list(spec.identity)
    kept_src = stored
    if obs is not None:
        obs["stored"] = Observation("lakesync_stored")
        kept_src = stored.observe(obs["stored"], F.count(F.lit(1)).alias("rows"))
    if strategy == "broadcast":
        s_ord = "_stored_order"
        # stored ordering value of every batch identity already stored; at most
        # one row per batch identity, so it is as small as the batch
        hits = (stored.select(*ids, F.col(spec.order).alias(s_ord))
                .join(F.broadcast(incoming.select(*ids)), ids, "left_semi")
                .groupBy(*ids).agg(F.max(s_ord).alias(s_ord), F.lit(True).alias(_UPDATED)))
        o = F.col(spec.order)
        # the batch row wins unless the stored ordering is greater (null is
        # lowest); an ordering tie goes to the batch row
        wins = F.col(s_ord).isNull() | (o.isNotNull() & (o >= F.col(s_ord)))
        winners = (incoming.join(F.broadcast(hits), ids, "left").where(wins).drop(s_ord)
                   .withColumn(_UPDATED, F.coalesce(_UPDATED, F.lit(False))))
        if winners_dir is not None:
            winners.write.mode("overwrite").parquet(winners_dir)
            winners = winners.sparkSession.read.schema(winners.schema).parquet(winners_dir)
        kept = kept_src.join(F.broadcast(winners.select(*ids)), ids, "left_anti")
        parts = [spec.partition] if spec.partition else []
        if parts and not spec.parallelism:  # noqa: SIM102
            # stored rows stay with the task that read them (a stored file
            # holds one partition); only the batch rows are laid out
            winners = _layout(winners, parts, None)
        merged = (kept.withColumns({SRC_COL: F.lit(0), _UPDATED: F.lit(False)})
                  .unionByName(winners.withColumn(SRC_COL, F.lit(1))))
        if spec.parallelism:
            # an explicit write parallelism is honoured with one rebalance
            merged = _layout(merged, parts, spec.parallelism, shares)
    else:
        # a stored row without a whole identity meets no batch row: a group of its own
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ids])
        both = (kept_src.withColumns({SRC_COL: F.lit(0), "_alone": F.when(~whole, F.monotonically_increasing_id())})
                .unionByName(incoming.withColumns({SRC_COL: F.lit(1), "_alone": F.lit(None).cast("bigint")})))
        own = Window.partitionBy(*ids, "_alone")
        fresh, old = F.col("_fresh"), F.col("_old")
        seen = both.withColumns({
            "_fresh": F.max(F.when(F.col(SRC_COL) == 1, F.col(spec.order))).over(own),
            "_old": F.max(F.when(F.col(SRC_COL) == 0, F.col(spec.order))).over(own),
            "_batch": F.max(SRC_COL).over(own), _UPDATED: F.min(SRC_COL).over(own) == 0})
        wins = old.isNull() | (fresh.isNotNull() & (fresh >= old))
        keep = F.when(F.col(SRC_COL) == 1, wins).otherwise((F.col("_batch") == 0) | ~wins)
        merged = seen.where(keep).drop("_fresh", "_old", "_batch", "_alone")
        if spec.partition or spec.parallelism:
            merged = _layout(merged, [spec.partition] if spec.partition else [], spec.parallelism, shares)
    if obs is not None:
        obs["out"] = Observation("lakesync_out")
        merged = merged.observe(obs["out"], F.count(F.lit(1)).alias("rows"),
                                F.count_if(F.col(SRC_COL) == 1).alias("incoming_won"),
                                F.count_if((F.col(SRC_COL) == 1) & F.col(_UPDATED)).alias("updated"))
    return merged.drop(_UPDATED)


def plan_upsert(batch: DataFrame, spec: TableSpec, spark: SparkSession | None = None,
                validate: Callable[[DataFrame], DataFrame] | None = None,
                obs: dict | None = None, exact_counts: bool = False,
                strategy: str = "auto") -> tuple[DataFrame, UpsertResult]:
    """The rows an upsert of ``batch`` would write, laid out as written,
    without writing them.

    The frame holds every row of every touched partition after the merge
    (plus the ``_src`` column: 1 where the incoming row won).  Use it to
    ``explain()`` the plan.  The batch is not materialized here, so with
    ``strategy="auto"`` one job measures it and only the broadcast bound is
    applied (the stored-to-batch ratio of :func:`upsert_to_path` needs the
    batch's files).
    ``exact_counts`` is accepted for symmetry with :func:`upsert_to_path`.
    """
    spark = spark or batch.sparkSession
    res = UpsertResult(spec.path)
    incoming = _incoming(batch, spec, None, validate, dedupe=True)
    res.created = not _table_exists(spark, spec)
    if res.created:
        merged = incoming.withColumn(SRC_COL, F.lit(1))
        if spec.partition:
            merged = _layout(merged, [spec.partition], spec.parallelism)
        res.strategy = "create"
        return merged, res
    if strategy != "shuffle":
        res.batch_bytes = measured_bytes(incoming, [*spec.identity, spec.order])
    res.strategy = choose_strategy(spark, spec, res.batch_bytes or 0, strategy)
    stored, _ = _read_stored(spark, spec, incoming.schema, incoming, res)
    merged = _merge(incoming, stored, spec, res.strategy, obs)
    return merged, res


def commit_staged(spark: SparkSession, staged: str, spec: TableSpec, schema: T.StructType) -> None:
    """Put a staged upsert result in place: the staged partitions replace the
    stored ones (all of an unpartitioned table).

    On the table's file system nothing is written again and the commit is
    recorded (:func:`lakesync.sinks.commit.commit`).  A result staged on another
    file system is first copied beside the table.  Either way only staged files
    are read, so this can be run again after a failure at any point."""
    if not same_store(spark, staged, spec.path):
        near = _fresh_stage(spec.path)
        _write(spark.read.schema(schema).parquet(staged), near, [spec.partition] if spec.partition else [])
        remove_path(spark, staged)
        staged = near
    commit(spark, spec, staged, schema, "merge")


def check_stored_schema(spark: SparkSession, spec: TableSpec, schema: T.StructType, dirs: list[str] | None = None) -> None:
    """Fail before anything is written if ``schema`` lacks a stored column or gives it another type.

    The stored schema is that of the last commit and the catalog's, if the
    table is published.  A table with neither (written by other means) is
    judged by the files of all touched folders ``dirs``, or of its path.  New
    columns are allowed."""
    name = spec.qualified_name if spec.table else None
    known = [recorded_schema(spark, spec.path)] if path_exists(spark, spec.path) else []
    known += [spark.table(name).schema] if name and spark.catalog.tableExists(name) else []
    known = [k for k in known if k is not None]
    if not known and dirs != []:
        reader = spark.read.option("basePath", spec.path) if dirs and dirs != [spec.path] else spark.read
        known = [reader.option("mergeSchema", "true").parquet(*(dirs or [spec.path])).schema]
    have = {f.name.lower(): f.dataType for f in schema.fields}
    stored = [f for k in known for f in k.fields]
    lost = sorted({f.name for f in stored if f.name.lower() not in have})
    # a partition column read from folder names has a guessed type
    other = sorted({f.name for f in stored if f.name != spec.partition and f.name.lower() in have
                    and have[f.name.lower()].simpleString() != f.dataType.simpleString()})
    if lost or other:
        raise ValueError(f"schema of {spec.path} changed incompatibly: columns missing {lost}, of another type {other}")


def _outside(path: str, table: str, what: str) -> None:
    if f"{path.rstrip('/')}/".startswith(f"{table.rstrip('/')}/"):
        raise ValueError(f"the {what} {path} lies inside the table {table}, which writes replace")


def _write(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Write a frame that is already laid out (no extra exchange)."""
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def _tagged_files(batch: DataFrame, spec: TableSpec, tagged: Callable[[DataFrame], DataFrame], rejects: str | None,
                  batch_id: str | int) -> tuple[DataFrame, dict[str | None, int]]:
    """The accepted rows of the batch, read from its tagged files, and the number of rows by reason."""
    from lakesync.sinks.rejects import store_rejects

    spark = batch.sparkSession
    rows = prepare_tagged(tagged(batch), spec)
    place = scratch_path(spark, "tagged")
    # a good row needs no copy of its source
    rows.withColumn(RAW, F.when(F.col(REJECT_REASON).isNotNull(), F.col(RAW))).write.option("compression", "zstd").parquet(place)
    rows = spark.read.schema(rows.schema).parquet(place)
    seen = {r[0]: r[1] for r in rows.groupBy(REJECT_REASON).count().collect()}
    if rejects:
        store_rejects(rows.where(F.col(REJECT_REASON).isNotNull()), rejects, str(batch_id))
    return rows.where(F.col(REJECT_REASON).isNull()).drop(REJECT_REASON, RAW), seen


def _metrics(obs: dict, name: str) -> dict:
    """Observed counts; none (all zero) where the plan was not run or was found empty, which drops its metrics."""
    if name not in obs:
        return defaultdict(int)
    try:
        return defaultdict(int, obs[name].get)
    except Py4JJavaError:
        return defaultdict(int)


def _observed(merged: DataFrame, obs: dict) -> DataFrame:
    obs["out"] = Observation("lakesync_out")
    return merged.observe(obs["out"], F.count(F.lit(1)).alias("rows"), F.count_if(F.col(SRC_COL) == 1).alias("incoming_won"))


def _versioned_target(spark: SparkSession, spec: TableSpec, schema: T.StructType) -> None:
    """The catalog table whose partitions a versioned commit switches; new columns are added to it."""
    from lakesync.catalog.publish import publish

    if not (spec.table and spec.partition):
        raise ValueError("a versioned table needs a catalog name and a partition column")
    if spark.catalog.tableExists(spec.qualified_name):
        check_stored_schema(spark, spec, schema)
    publish(spark, spec, schema)


def upsert_to_path(batch: DataFrame, spec: TableSpec, spark: SparkSession | None = None,
                   validate: Callable[[DataFrame], DataFrame] | None = None,
                   exact_counts: bool = False, stage_path: str | None = None, strategy: str = "auto",
                   tagged: Callable[[DataFrame], DataFrame] | None = None, rejects: str | None = None, batch_id: str | int = 0) -> UpsertResult:
    """Upsert ``batch`` into the table at ``spec.path`` (K4 over K2).

    ``validate`` maps the raw batch to its acceptable rows (e.g. a conform
    step); rows it drops are counted as rejected.  Replaying the same batch
    leaves the table unchanged (tie rule), so a retried streaming micro-batch
    is harmless.  ``exact_counts`` reports ``superseded`` split into
    ``duplicates`` (beaten inside the batch) and ``stale`` (beaten by the
    stored row); the batch is deduplicated anyway, so it costs nothing extra.

    ``strategy`` is ``auto``, ``broadcast`` or ``shuffle``.  ``auto`` takes
    the broadcast merge when the measured batch is within
    :func:`lakesync.operators.sizing.broadcast_bound` *and* the stored
    partitions it touches hold at least ``STORED_TO_BATCH_RATIO`` times its
    bytes on disk; otherwise the shuffle merge, which moves about as much
    data and runs fewer jobs when the stored side is not much larger.

    The merged partitions are written once, to a fresh folder beside the table
    (``spec.versioned``: under it), and put in place by a recorded commit: the
    job that reads the table never replaces it.  Until the commit is decided a
    killed run leaves the table as it was; after that the next upsert, or
    :func:`lakesync.sinks.commit.recover`, finishes it.

    ``tagged`` is used instead of ``validate``: it maps the batch to rows with
    ``_reject_reason`` and ``_raw`` (see
    :func:`lakesync.functions.conform_tagged`).  The tagged rows are written once
    to the shared folder and everything is counted from such files, or by the
    tasks that write the result, so the counts are exact even when a lost
    executor has stages run again.  With ``rejects`` the rejected rows go to the
    store at that path (:mod:`lakesync.sinks.rejects`) under ``batch_id``, before
    the table is changed.

    ``stage_path`` fixes the staging folder (the streaming sink uses one per
    batch id under its checkpoint); the deduplicated batch goes next to it,
    in ``<stage_path>.batch`` and the winning batch rows of a broadcast merge
    in ``<stage_path>.winners``.  If a complete staged result is already there
    -- a previous attempt died during its commit -- it is committed as it is
    instead of merging again, so a replay after a crash restores the
    partitions exactly.
    """
    spark = spark or batch.sparkSession
    if stage_path:
        _outside(stage_path, spec.path, "staging folder")
    recover(spark, spec.path)
    if stage_path and not spec.versioned and path_exists(spark, f"{stage_path}/_SUCCESS"):
        res = UpsertResult(spec.path, staged=stage_path)
        log.warning("committing the staged result left by an earlier attempt: %s", stage_path)
        plain = batch if tagged is None else tagged(batch).drop(REJECT_REASON, RAW)
        schema = _incoming(plain, spec, None, validate, dedupe=False).schema
        commit_staged(spark, stage_path, spec, schema)
        remove_path(spark, stage_path)
        remove_path(spark, f"{stage_path.rstrip('/')}.batch")
        remove_path(spark, f"{stage_path.rstrip('/')}.winners")
        res.staged, res.extra["recovered"] = None, True
        return res
    obs: dict = {}
    res = UpsertResult(spec.path)
    seen: dict[str | None, int] | None = None
    if tagged is not None:
        batch, seen = _tagged_files(batch, spec, tagged, rejects, batch_id)
        validate = None
    incoming = _incoming(batch, spec, obs, validate, dedupe=True)
    parts = [spec.partition] if spec.partition else []
    res.created = not _table_exists(spark, spec)
    number = next_number(spark, spec.path)
    if spec.versioned:
        _versioned_target(spark, spec, incoming.schema)
    staged = version_path(spec.path, number) if spec.versioned else stage_path or _fresh_stage(spec.path)
    batch_dir = None
    if res.created and not spec.parallelism:
        # no stored rows to merge with: the batch is the table
        res.strategy = "create"
        merged = incoming.withColumn(SRC_COL, F.lit(1))
        merged = _observed(_layout(merged, parts, None) if parts else merged, obs)
        _write(merged.drop(SRC_COL), staged, parts)
        commit(spark, spec, staged, incoming.schema, "switch" if spec.versioned else "overwrite", number)
    else:
        # the deduplicated batch is written once; the measurement rides along
        work = stage_path or scratch_path(spark, "upsert")
        batch_dir, winners_dir = f"{work.rstrip('/')}.batch", f"{work.rstrip('/')}.winners"
        incoming.write.mode("overwrite").parquet(batch_dir)
        res.batch_bytes = int(_metrics(obs, "dedup")["bytes"])
        if _metrics(obs, "dedup")["rows"] > 0 or res.created:
            inc = spark.read.schema(incoming.schema).parquet(batch_dir)
            if res.created:
                res.strategy = "create"
                merged = _observed(_layout(inc.withColumn(SRC_COL, F.lit(1)), parts, spec.parallelism, _shares(inc, parts, spec.parallelism)), obs)
            else:
                stored, dirs = _read_stored(spark, spec, inc.schema, inc, res)
                check_stored_schema(spark, spec, inc.schema, dirs)
                res.strategy = choose_strategy(spark, spec, res.batch_bytes, strategy)
                if strategy == "auto" and res.strategy == "broadcast" and not _stored_outweighs(spark, dirs, batch_dir):
                    res.strategy = "shuffle"
                shares = _shares(inc.select(*parts).unionByName(stored.select(*parts)), parts, spec.parallelism) if parts and spec.parallelism else {}
                merged = _merge(inc, stored, spec, res.strategy, obs, winners_dir=winners_dir, shares=shares)
            _write(merged.drop(SRC_COL), staged, parts)
            res.staged = staged
            log.info("staged upsert of %s in %s", spec.path, staged)
            if spec.versioned:
                commit(spark, spec, staged, inc.schema, "switch", number)
            else:
                commit_staged(spark, staged, spec, inc.schema)
            res.staged = None
        remove_path(spark, batch_dir)
        remove_path(spark, winners_dir)
    if spec.key_buckets:
        from lakesync.sinks.keys import sync_keys

        sync_keys(spark, spec)

    dedup_n = _metrics(obs, "dedup")["rows"]
    if seen is not None:
        rows_in, good_n = sum(seen.values()), seen.get(None, 0)
        res.extra["reasons"] = {k: v for k, v in seen.items() if k is not None}
    else:
        rows_in, good_n = _metrics(obs, "in")["rows"], _metrics(obs, "good")["rows"]
    out, stored_n = _metrics(obs, "out"), _metrics(obs, "stored")["rows"]
    res.rows_in = rows_in
    res.rejected = rows_in - good_n
    res.stored_read = stored_n
    res.updated = out["updated"]
    res.inserted = out["incoming_won"] - res.updated
    res.superseded = good_n - out["incoming_won"]
    if exact_counts:
        res.duplicates = good_n - dedup_n
        res.stale = dedup_n - out["incoming_won"]
    return res
