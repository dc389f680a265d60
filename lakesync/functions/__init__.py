"""Column expressions (F1, F3-F6) and schema conformance (F2)."""

from lakesync.functions.columns import (
    parse_ts,
    partition_path,
    partition_value,
    parse_urn,
    record_key,
    with_partition_path,
    with_record_key,
)
from lakesync.functions.conform import conform, conform_tagged

__all__ = [
    "parse_ts",
    "partition_path",
    "partition_value",
    "parse_urn",
    "record_key",
    "with_partition_path",
    "with_record_key",
    "conform",
    "conform_tagged",
]
