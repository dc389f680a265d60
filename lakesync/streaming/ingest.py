"""Structured Streaming ingest: every input file is consumed exactly once.

The file source records consumed files in the checkpoint; ``foreachBatch``
upserts each micro-batch with :func:`lakesync.sinks.upsert_to_path`.  A
micro-batch that is replayed after a failure is a no-op by the winner rule,
and a batch whose commit was cut short finds its staged result under the
checkpoint and commits it again, so the sink is effectively exactly-once
without a transaction log of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakesync.schema import as_struct, with_string_field
from lakesync.sinks.table import UpsertResult, upsert_to_path
from lakesync.sources.json_files import TS_NTZ_FORMAT
from lakesync.spec import TableSpec


def read_json_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                     max_files_per_trigger: int | None = None, corrupt_col: str | None = None,
                     max_bytes_per_trigger: str | int | None = None) -> DataFrame:
    """Streaming JSON scan with a declared schema (S3).

    With ``corrupt_col`` a line that does not fit the schema keeps its raw
    text in that column, so the conform step can reject it.
    ``max_files_per_trigger`` or ``max_bytes_per_trigger`` (e.g. ``"20g"``)
    bound each micro-batch, so a large backlog is consumed in batches of a
    known size (an available-now run still consumes all of it).
    """
    st = as_struct(schema)
    if corrupt_col:
        st = with_string_field(st, corrupt_col)
    r = (spark.readStream.schema(st).option("mode", "PERMISSIVE")
         .option("timestampNTZFormat", TS_NTZ_FORMAT))
    if corrupt_col:
        r = r.option("columnNameOfCorruptRecord", corrupt_col)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
    return r.json(path)


def start_upsert_stream(stream: DataFrame, spec: TableSpec, checkpoint: str,
                        transform: Callable[[DataFrame], DataFrame] | None = None,
                        available_now: bool = True, processing_time: str | None = None,
                        on_batch: Callable[[int, UpsertResult], None] | None = None,
                        query_name: str | None = None, exact_counts: bool = False,
                        tagged: Callable[[DataFrame], DataFrame] | None = None, rejects: str | None = None) -> StreamingQuery:
    """Start a streaming upsert into ``spec.path``.

    ``transform`` maps each micro-batch to its acceptable rows before the
    upsert (e.g. conform); what it drops is counted as rejected.  ``tagged``
    takes its place where rejects are counted by reason and kept in the store
    ``rejects``, under the batch id.  ``available_now`` processes what is there and stops; otherwise the query
    runs on ``processing_time`` triggers.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        # one staging folder per batch id in the durable checkpoint: a batch
        # replayed after a crash during its commit re-commits that result
        stage = f"{checkpoint.rstrip('/')}/_staged/batch={batch_id}"
        res = upsert_to_path(batch, spec, batch.sparkSession, validate=transform, exact_counts=exact_counts,
                             stage_path=stage, tagged=tagged, rejects=rejects, batch_id=batch_id)
        res.extra["batch_id"] = batch_id
        if on_batch:
            on_batch(batch_id, res)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_upsert_stream(spark: SparkSession, source: str, schema: T.StructType | str, spec: TableSpec,
                      checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                      max_files_per_trigger: int | None = None,
                      corrupt_col: str | None = None, exact_counts: bool = False,
                      max_bytes_per_trigger: str | int | None = None,
                      tagged: Callable[[DataFrame], DataFrame] | None = None, rejects: str | None = None) -> list[UpsertResult]:
    """Ingest everything available under ``source`` and stop; returns one
    result per micro-batch."""
    results: list[UpsertResult] = []
    stream = read_json_stream(spark, source, schema, max_files_per_trigger, corrupt_col, max_bytes_per_trigger)
    q = start_upsert_stream(stream, spec, checkpoint,
                            transform=transform, on_batch=lambda _, r: results.append(r),
                            exact_counts=exact_counts, tagged=tagged, rejects=rejects)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return results
