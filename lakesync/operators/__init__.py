"""Key-based data operators (K1-K3), partition drift (C2, C4) and audits (V1-V6)."""

from lakesync.operators.merge import latest_per_key, tag, upsert, SRC_COL
from lakesync.operators.drift import needs_sync, partition_drift, schema_drift
from lakesync.operators.audits import (
    audit_databases,
    audit_datasets,
    audit_paths,
    audit_tables,
    check_table,
    find_dataset,
    verdict,
)
from lakesync.operators.history import check_history, latest_checks, record_checks, run_changes, verdict_changes

__all__ = [
    "latest_per_key", "tag", "upsert", "SRC_COL",
    "needs_sync", "partition_drift", "schema_drift",
    "audit_databases", "audit_datasets", "audit_paths", "audit_tables",
    "check_table", "find_dataset", "verdict",
    "check_history", "latest_checks", "record_checks", "run_changes", "verdict_changes",
]
