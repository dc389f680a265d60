"""Exact top-k inner products through a pivot-distance index (operator 5).

An extra component lifts all vectors to one norm, so the largest inner product
becomes the smallest Euclidean distance.  Every vector is keyed by its nearest
pivot and its distance to it; in that order the rows of a pivot are cut into
annuli of at most ``block`` rows.  By the triangle inequality an annulus [lo,
hi] around pivot p holds nothing nearer to a query q than max(d(q, p) - hi,
lo - d(q, p)).  Queries, in blocks of neighbours, take annuli by that bound,
in rounds that widen fourfold, and stop when every bound left exceeds the
distance of their k-th best.  No annulus within the bound is left out, so the
result is exact; scores come from the original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import stored
from lakesync.llm.vectors import matrix_of, packed, rows_of, usable, widest


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]), 1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _keyed(pivots: np.ndarray, dim: int, top: float, query: bool):
    """Adds the nearest pivot and the distance to it (queries have 0 as the extra component)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("v"), dim)
                d = _distances(np.concatenate((x, np.zeros((len(x), 1))), 1) if query else _lifted(x, top), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])],
                                                 ["id", "v", "pivot", "d"])

    return run


_BLOCK = "block long, pivot int, lo double, hi double, n int, ids binary, vecs binary"


def _blocks(size: int):
    """Runs of at most ``size`` consecutive rows of one pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, pivot = TaskContext.get().partitionId() << 24, [], None

        def block():
            nonlocal made
            d = [h[1] for h in held]
            out = pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([pivot], pa.int32()), pa.array([min(d)]), pa.array([max(d)]), pa.array([len(held)], pa.int32()),
                                              pa.array([np.array([h[0] for h in held], np.int64).tobytes()]), pa.array([b"".join(h[2] for h in held)])],
                                             ["block", "pivot", "lo", "hi", "n", "ids", "vecs"])
            made += 1
            held.clear()
            return out

        for batch in batches:
            for i, p, d, v in zip(*(batch.column(c).to_pylist() for c in ("id", "pivot", "d", "v"))):
                if held and (p != pivot or len(held) == size):
                    yield block()
                pivot = p
                held.append((i, d, v))
        if held:
            yield block()

    return run


def _query_intervals(pivots: np.ndarray, dim: int):
    """For each block of queries and pivot, the least and greatest distance of its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vecs in zip(batch.column("block").to_pylist(), batch.column("vecs").to_pylist()):
                x = np.frombuffer(vecs).reshape(-1, dim)
                d = _distances(np.concatenate((x, np.zeros((len(x), 1))), 1), pivots)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(pivots), pa.int64()), pa.array(np.arange(len(pivots), dtype=np.int32)),
                                                  pa.array(d.min(0)), pa.array(d.max(0))], ["qblock", "pivot", "near", "far"])

    return run


def _scored(dim: int, k: int):
    """The k best of each data block for each query of a query block; merged over the rows of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[int, list] = {}
            for qblock, q_ids, q_vecs, ids, vecs in zip(*(batch.column(c) for c in ("qblock", "q_ids", "q_vecs", "ids", "vecs"))):
                q_id, q = np.frombuffer(q_ids.as_py(), np.int64), np.frombuffer(q_vecs.as_py()).reshape(-1, dim)
                x_id, x = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(vecs.as_py()).reshape(-1, dim)
                score = q @ x.T
                score[q_id[:, None] == x_id[None, :]] = -np.inf
                keep = min(k, len(x_id))
                # the k-th best score of each query; ties with it are settled by id below
                floor = np.partition(score, len(x_id) - keep, 1)[:, len(x_id) - keep]
                row, col = np.nonzero((score >= floor[:, None]) & np.isfinite(score))
                best.setdefault(qblock.as_py(), []).append((q_id[row], x_id[col], score[row, col]))
            for parts in best.values():
                a, b, s = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((b, -s, a))
                a, b, s = a[order], b[order], s[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                yield pa.RecordBatch.from_arrays([pa.array(c[place < k]) for c in (a, b, s)], ["query_id", "vec_id", "score"])

    return run


def top_inner(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = 32, block: int = 1024, query_block: int = 256, first: int = 8,
              id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (double): the k largest inner products of each query with all rows but those of its id.

    Ties go to the smaller vec_id.  Vectors that are null, empty or hold a null or
    non-finite component take no part, nor do null ids; shorter vectors are
    padded with zeros.  Of query rows that repeat an id one takes part (the
    greatest vector); repeated rows are candidates each.  Pivots are the first
    ``pivots`` distinct vectors by a hash of the id: a bounded sample that
    decides speed only."""
    spark = vectors.sparkSession
    clean = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    asked = queries.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    dim = max(widest(clean, vec_col), widest(asked, vec_col))
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return none
    data = packed(clean, id_col, vec_col, dim)
    ask = packed(asked, id_col, vec_col, dim).groupBy("id").agg(F.max("v").alias("v"))
    picked = [r.v for r in data.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    if not picked:
        return none
    top = float(clean.agg(F.max(F.aggregate(F.col(vec_col).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))).first()[0]) * (1 + 1e-9)
    centers = _lifted(matrix_of(sorted({bytes(p) for p in picked}), dim), top)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(frame, size, query):
        keyed = frame.mapInArrow(_keyed(centers, dim, top, query), "id long, v binary, pivot int, d double")
        ordered = keyed.repartitionByRange(parts, "pivot", "d", "id").sortWithinPartitions("pivot", "d", "id")
        return stored(ordered.mapInArrow(_blocks(size), _BLOCK), "annuli")

    blocks, asks = cut(data, block, False), cut(ask, query_block, True)
    q_rows = asks.select(F.col("block").alias("qblock"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    # (query block, annulus, bound), by bound
    near = asks.mapInArrow(_query_intervals(centers, dim), "qblock long, pivot int, near double, far double")
    bound = F.greatest(F.col("near") - F.col("hi"), F.col("lo") - F.col("far"), F.lit(0.0)) * (1 - 1e-9) - 1e-6
    pairs = near.join(blocks.select("block", "pivot", "lo", "hi"), "pivot").select("qblock", "block", bound.alias("bound"))
    pairs = stored(pairs.withColumn("place", F.row_number().over(Window.partitionBy("qblock").orderBy("bound", "block"))), "annulus-bounds")
    # the queries of each block with their squared norm, for the distance of a score
    def norms(batches):
        for batch in batches:
            for b, ids, vecs in zip(*(batch.column(c).to_pylist() for c in ("qblock", "q_ids", "q_vecs"))):
                x = np.frombuffer(vecs).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(x), pa.int64()), pa.array(np.frombuffer(ids, np.int64)), pa.array((x * x).sum(1))], ["qblock", "query_id", "square"])

    members = stored(q_rows.mapInArrow(norms, "qblock long, query_id long, square double"), "query-rows")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, done, upto = None, 0, first
    reach = members.select("qblock").distinct().withColumn("reach", F.lit(float("inf")))
    while True:
        turn = pairs.where((F.col("place") > done) & (F.col("place") <= upto)).join(reach, "qblock").where("bound <= reach").select("qblock", "block")
        scored = (turn.join(q_rows, "qblock").join(blocks.select("block", "ids", "vecs"), "block")
                  .select("qblock", "q_ids", "q_vecs", "ids", "vecs").mapInArrow(_scored(dim, k), "query_id long, vec_id long, score double"))
        rows = scored if found is None else found.unionByName(scored)
        found = stored(rows.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k).drop("place"), "best")
        # how far a block of queries must still look: to the k-th best of its worst query
        kth = found.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == k).select("query_id", "score")
        far = F.sqrt(F.greatest(F.col("square") + F.lit(top) - 2 * F.col("score"), F.lit(0.0)))
        reach = stored(members.join(kth, "query_id", "left").groupBy("qblock").agg(F.max(F.coalesce(far, F.lit(float("inf")))).alias("reach")), "reach")
        done, upto = upto, upto * 4
        if pairs.where(F.col("place") > done).join(reach, "qblock").where("bound <= reach").isEmpty():
            break
    return found.select("query_id", F.row_number().over(by_score).cast("int").alias("rank"), "vec_id", "score")


__all__ = ["top_inner"]
