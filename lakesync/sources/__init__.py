"""Sources and scans."""

from lakesync.sources.json_files import read_json, read_json_inferred, write_json
from lakesync.sources.files import (
    file_manifest,
    read_partitions,
    read_table,
    storage_listing,
    storage_partitions,
)
from lakesync.sources.catalog_snapshot import catalog_snapshot, database_snapshot

__all__ = [
    "read_json", "read_json_inferred", "write_json", "file_manifest", "read_partitions", "read_table",
    "storage_listing", "storage_partitions", "catalog_snapshot", "database_snapshot",
]
