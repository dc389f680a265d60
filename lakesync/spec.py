"""Table descriptor shared by every operator, sink and plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesync.functions.columns import TS_PATTERN


@dataclass(frozen=True)
class TableSpec:
    """What identifies a row and where the table lives.

    ``keys``       record-key fields (the SIMPLE key generator uses one).
    ``order``      ordering (precombine) field: the greatest value wins.
    ``partition``  name of the partition column in the stored table.
    ``partition_expr``  SQL expression (or a function returning a Column)
                   that derives the partition value from an incoming row;
                   ``None`` means the column already holds it.
    ``tie``        extra ordering columns used when ``order`` is tied.
    ``parallelism`` target number of write tasks; ``None`` leaves it to AQE.
    ``broadcast_bytes`` size bound of the broadcast merge (see below).
    """

    path: str
    keys: tuple[str, ...]
    order: str
    partition: str | None = None
    partition_expr: str | Callable[[], Column] | None = None
    tie: tuple[str, ...] = ()
    parallelism: int | None = None
    database: str = "default"
    table: str | None = None
    # partitions touched by one batch are pruned by value up to this many;
    # beyond it the stored side is filtered with a semi-join instead.
    max_pruned_partitions: int = 10_000
    # an upsert batch whose identity and ordering columns measure at most this
    # many bytes is merged by broadcast joins (stored rows are not shuffled);
    # None uses the session's spark.sql.autoBroadcastJoinThreshold, and a
    # value <= 0 always uses the shuffle merge.
    broadcast_bytes: int | None = None
    # a string ordering field is parsed by this pattern in every run; None keeps it a string
    order_format: str | None = TS_PATTERN
    # each commit of a partitioned, published table writes new folders and
    # switches the catalog's partition locations to them
    versioned: bool = False
    # upserts keep a lookup of the stored identities, in this many buckets
    key_buckets: int | None = None

    def __post_init__(self):
        if isinstance(self.keys, str):
            object.__setattr__(self, "keys", (self.keys,))
        if isinstance(self.tie, str):
            object.__setattr__(self, "tie", (self.tie,))

    @property
    def identity(self) -> list[str]:
        """Row identity: (partition value, record key)."""
        return ([self.partition] if self.partition else []) + list(self.keys)

    @property
    def qualified_name(self) -> str:
        if not self.table:
            raise ValueError("spec has no table name")
        return f"{self.database}.{self.table}"

    def partition_column(self) -> Column:
        if self.partition_expr is None:
            return F.col(self.partition)
        if isinstance(self.partition_expr, str):
            return F.expr(self.partition_expr)
        return self.partition_expr()
