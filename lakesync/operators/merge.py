"""Keep-latest, upsert and insert/update tagging.

Identity is (partition value, record key).  The winner of an identity is the
row with the greatest ordering value (null lowest); on a tie an incoming row
beats a stored one, and a remaining tie is settled by the greatest ``tie``
columns.  The rule is total, so results are deterministic and replaying a batch
changes nothing.

Plan shape: ``row_number() = 1`` over ``Window.partitionBy(identity)`` lets
Catalyst insert a partial ``WindowGroupLimit`` *before* the shuffle, so every
map task forwards at most one row per identity.  A hot key that holds a third of
the input therefore reaches its reduce task as at most one row per map task,
which is why no salting is needed here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesync.operators.sizing import broadcast_bound, measured_bytes

SRC_COL = "_src"  # 0 = stored row, 1 = incoming row
_RN = "_rn"


def _ordering(order: str | Sequence[str], tie: Sequence[str] = ()) -> list[Column]:
    orders = [order] if isinstance(order, str) else list(order)
    return [F.col(c).desc_nulls_last() for c in [*orders, *tie]]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str | Sequence[str],
                   tie: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: the greatest ``order`` (then ``tie``) value (K1)."""
    w = Window.partitionBy(*keys).orderBy(*_ordering(order, tie))
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) == 1).drop(_RN)


def upsert(base: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str,
           tie: Sequence[str] = ()) -> DataFrame:
    """Merge ``incoming`` into ``base`` (K2).

    Equivalent to keep-latest over ``base ∪ incoming`` with the source as the
    first tie-breaker.  Rows of ``incoming`` below the stored ordering value are
    late and drop out.  ``incoming`` may carry columns in another order; it is
    aligned by name.
    """
    both = (base.withColumn(SRC_COL, F.lit(0))
            .unionByName(incoming.withColumn(SRC_COL, F.lit(1))))
    return latest_per_key(both, keys, [order, SRC_COL], tie).drop(SRC_COL)


def tag(incoming: DataFrame, stored_keys: DataFrame, keys: Sequence[str], col: str = "op",
        broadcast_bytes: int | None = None) -> DataFrame:
    """Mark each incoming row ``I`` (identity not stored yet) or ``U`` (K3).

    ``stored_keys`` may contain duplicates and extra columns.  The key bytes
    of the batch are measured first (one job over the batch, no shuffle); they
    bound the size of its distinct identities:

    * within the bound (``broadcast_bytes``, by default the session's
      ``spark.sql.autoBroadcastJoinThreshold``) they are broadcast to a
      semi-join with the stored keys, so the stored side is scanned and
      filtered but never shuffled whole -- only the stored identities the
      batch carries are de-duplicated (partially, map-side) and the result,
      at most one row per batch identity, is broadcast back;
    * beyond it the stored side is reduced to its distinct identities
      (partial aggregation before the shuffle) and left-joined; AQE still
      turns that join into a broadcast at run time when the measured key side
      is small, and splits skewed join partitions.
    """
    keys = list(keys)
    marker = "_stored"
    ids = incoming.select(*keys).distinct()
    bound = broadcast_bound(incoming.sparkSession, broadcast_bytes)
    # the key bytes of all batch rows bound those of its distinct identities,
    # and measuring them needs no shuffle
    size = measured_bytes(incoming, keys) if bound > 0 else bound + 1
    if size <= bound:
        present = (stored_keys.select(*keys).join(F.broadcast(ids), keys, "left_semi")
                   .distinct().withColumn(marker, F.lit(True)))
        joined = incoming.join(F.broadcast(present), on=keys, how="left")
    else:
        present = stored_keys.select(*keys).distinct().withColumn(marker, F.lit(True))
        joined = incoming.join(present, on=keys, how="left")
    return (joined.withColumn(col, F.when(F.col(marker), F.lit("U")).otherwise(F.lit("I")))
            .drop(marker))
