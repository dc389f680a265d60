"""Sinks: partitioned Parquet writes (W1, W2, W4) and the copy-on-write upsert (K4)."""

from lakesync.sinks.commit import journal, recorded_schema, recover, vacuum
from lakesync.sinks.table import (
    UpsertResult,
    commit_staged,
    plan_upsert,
    prepare_batch,
    upsert_to_path,
    write_table,
)

__all__ = ["UpsertResult", "commit_staged", "journal", "plan_upsert", "prepare_batch", "recorded_schema", "recover", "upsert_to_path", "vacuum", "write_table"]
