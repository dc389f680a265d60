"""Catalog publication (C1, C3, C5) on the session catalog."""

from lakesync.catalog.publish import (
    catalog_partitions,
    describe_dataset,
    described_spec,
    publish,
    read_spec,
    spec_properties,
    sync_partitions,
    table_columns,
)

__all__ = ["catalog_partitions", "describe_dataset", "described_spec", "publish", "read_spec", "spec_properties",
           "sync_partitions", "table_columns"]
