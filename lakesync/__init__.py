"""lakesync: keyed lakehouse tables on plain Spark.

Ingest JSON in batch or as a stream, conform it to a schema, keep the latest
row per (partition, key), upsert into hive-style partitioned Parquet, publish
tables and partitions to the Spark catalog, and audit catalog, storage and a
metadata-registry export against what is expected.  Every step is a DataFrame,
SQL or Structured Streaming job.
"""

from lakesync.spec import TableSpec

__all__ = ["TableSpec"]
