"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.session import remove_path, scratch_path

#: The folders written inside each open :func:`passing`.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What :func:`stored` writes inside is removed at the end, unless it ``outlives`` the block.

    Nothing that is read later may depend on it."""
    folders: list[str] = []
    outer = _PASSING.set((*_PASSING.get(), folders))
    try:
        yield
    finally:
        _PASSING.reset(outer)
        for folder in folders:
            remove_path(spark, folder)


def stored(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and several consumers read files instead of repeating the work."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    open_lists = _PASSING.get()[:-1] if outlives else _PASSING.get()
    if open_lists:
        open_lists[-1].append(path.rsplit("/", 1)[0])
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the text operators need, under fixed names; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of ``column`` (one row at least)."""
    col = batch.column(column)
    n = len(col)
    if n == 0:
        return
    size = np.cumsum(text_lengths(col))
    start = 0
    while start < n:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed as ``z``, null if null: for shuffles of whole texts, whose files count."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for own in byte_slices(batch, "text"):
            texts = own.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            z = pa.array([None if t is None else zip_.compress(t) for t in texts], pa.binary())
            rest = [c for c in own.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([own.column(c) for c in rest] + [z], [*rest, "z"])


def unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of some MB with the bytes of the texts back as ``text``."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "z"]
        start, size, texts = 0, 0, []
        for i, z in enumerate(batch.column("z")):
            texts.append(unzip.decompress(z.as_py()) if z.is_valid else None)
            size += len(texts[-1] or b"")
            if size > 4 << 20 or i + 1 == batch.num_rows:
                part = batch.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [pa.array(texts, pa.large_binary())], [*rest, "text"])
                start, size, texts = i + 1, 0, []


def with_scores(docs: DataFrame, scores, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text",
                slice_bytes: int = 1 << 20) -> DataFrame:
    """doc_id and score = ``scores(texts)`` of every row, then the columns ``keep`` as they were."""
    import pyarrow.compute as pc

    more = [c for c in keep if c not in (id_col, text_col)]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.struct(*[F.col(c) for c in more], F.lit(0).alias("_")).alias("more"))
    given = own.select("doc_id", *(["text", "more"] if keep else []))
    names = given.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                score = pa.array(scores(pc.fill_null(part.column("text"), "")), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [score], [*names, "score"])

    out = own.mapInArrow(run, given.withColumn("score", F.lit(0.0)).schema)
    known = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return out.select("doc_id", "score", *[known.get(c, F.col("more")[c]).alias(c) for c in keep if c != "doc_id"])


def text_lengths(col: pa.Array) -> np.ndarray:
    """Byte lengths of a string or binary column (null: 0)."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, concatenated, and the n + 1 row bounds."""
    kind = pa.large_binary()
    col = col.cast(pa.large_string()).cast(kind) if not pa.types.is_large_binary(col.type) else col
    bounds = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[bounds[0]:bounds[-1]], bounds - bounds[0]


def grouped_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of consecutive rows that share ``key``, over batch borders.

    The input must be clustered by ``key`` (repartition and sort before)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts = np.concatenate(([0], cuts))
        stops = np.concatenate((cuts, [len(keys)]))
        for a, b in zip(starts, stops):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


__all__ = ["table", "passing", "stored", "id_text", "byte_slices", "zipped", "unzipped", "with_scores", "text_lengths", "text_bytes", "grouped_rows"]
