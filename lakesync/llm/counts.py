"""Exact token counts with overlap resynchronisation (operator 3).

Texts up to ``chunk_chars`` are counted whole.  A longer text is cut into
overlapping chunks that are spread over tasks and encoded with offsets.  Two
neighbouring chunks are spliced at the first pre-token bound that both have in
their overlap, away from its ends.  Such a bound is proven stable: the pattern
runs from left to right and never looks behind, so what follows a common bound
is cut alike in both chunks, and the margins keep out what a cut end could have
changed (a cut special string, contraction or white space run).  Pairs without
a common bound are encoded again with chunks and overlaps ``widen`` times as
wide, until they align or one chunk holds the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import byte_slices, id_text, stored
from lakesync.llm.tokens import byte_part_table, count_column, json_tokenizer, loaded, spaced_parts

# more characters than a special string or contraction cut at a chunk's end can reach
MARGIN = 64


def _tokenizer(path: str):
    return loaded(("plain", path), lambda: json_tokenizer(path))


def _count_short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = byte_part_table((path,), lambda: json_tokenizer(path))
        for batch in batches:
            for own in byte_slices(batch, "text"):
                text = own.column("text")
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()),
                                                  pa.array(count_column(parts, text, spaced_parts), pa.int64())],
                                                 ["doc_id", "n_bytes", "n_tokens"])

    return run


def _chunks(chunk: int, overlap: int):
    """Rows (text_key, doc_id, n_bytes, chunk number, first character, number of chunks, text)."""
    names = ["text_key", "doc_id", "n_bytes", "k", "first", "chunks", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c) for c in ("text_key", "doc_id", "text"))):
                key, doc_id, text = key.as_py(), doc_id.as_py(), text.as_py()
                n, size = max(1, -(-len(text) // chunk)), len(text.encode())
                for k in range(n):
                    own = text[k * chunk:(k + 1) * chunk + (overlap if k + 1 < n else 0)]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (key, doc_id, size, k, k * chunk, n, own)))], schema=_CHUNK)

    return run


_CHUNK = pa.schema([("text_key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("k", pa.int64()),
                    ("first", pa.int64()), ("chunks", pa.int64()), ("text", pa.large_string())])


def word_bounds(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Characters at which a pre-token begins, and the ids before each."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
    starts = np.array([o[0] for o in encoding.offsets], np.int64)
    begin = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
    return starts[begin], begin


def _count_chunks(path: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            rows = batch.drop_columns(["text"]).to_pylist()
            for row, text in zip(rows, batch.column("text")):
                text = text.as_py()
                enc = tok.encode(text, add_special_tokens=False)
                at, before = word_bounds(enc)
                more = row["k"] + 1 < row["chunks"]
                stop = len(text) - overlap  # the next chunk begins here
                head = (at >= MARGIN) & (at < overlap) if row["k"] else np.zeros(len(at), bool)
                tail = (at >= stop + MARGIN) & (at < len(text) - MARGIN) if more else np.zeros(len(at), bool)
                row |= {"ids": len(enc.ids), "head_at": (at[head] + row["first"]).tolist(), "head_ids": before[head].tolist(),
                        "tail_at": (at[tail] + row["first"]).tolist(), "tail_ids": before[tail].tolist()}
            yield pa.RecordBatch.from_pylist(rows, schema=_COUNTED)

    return run


_COUNTED = pa.schema([(n, pa.int64()) for n in ("text_key", "doc_id", "n_bytes", "k", "first", "chunks", "ids")]
                     + [(n, pa.list_(pa.int64())) for n in ("head_at", "head_ids", "tail_at", "tail_ids")])
_COUNTED_DDL = ("text_key long, doc_id long, n_bytes long, k long, first long, chunks long, ids long, head_at array<long>, "
                "head_ids array<long>, tail_at array<long>, tail_ids array<long>")


def _at(where: str, ids: str) -> Column:
    """The ids before character ``cut``."""
    return F.expr(f"try_element_at({ids}, cast(array_position({where}, cut) as int))")


def count_tokens(docs: DataFrame, tokenizer_path: str, chunk_chars: int = 1 << 15, overlap: int = 1 << 10, widen: int = 8,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every whole text, as the library counts it.

    ``tokenizer_path`` is a byte-level tokenizers file; special strings inside
    texts count as the library's default has it.  Null and empty texts have 0
    bytes and tokens; null and repeated ids are carried row by row; other
    columns are ignored."""
    own = id_text(docs, id_col, text_col)
    short = own.where(F.length("text") <= chunk_chars).mapInArrow(_count_short(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    # equal ids may repeat, so each long text gets a key of its own, kept by the first write
    todo = stored(own.where(F.length("text") > chunk_chars).select(F.monotonically_increasing_id().alias("text_key"), "doc_id", "text"), "long-texts")
    done, chunk = [short], chunk_chars
    while True:
        cut = todo.mapInArrow(_chunks(chunk, overlap), "text_key long, doc_id long, n_bytes long, k long, first long, chunks long, text string")
        counted = stored(cut.repartition("text_key", "k").mapInArrow(_count_chunks(tokenizer_path, overlap), _COUNTED_DDL), "chunk-counts")
        right = counted.where("k > 0").select("text_key", (F.col("k") - 1).alias("k"), "head_at", "head_ids")
        left = counted.where("k + 1 < chunks").select("text_key", "k", "tail_at", "tail_ids")
        seams = stored(left.join(right, ["text_key", "k"]).withColumn("cut", F.expr("try_element_at(array_intersect(tail_at, head_at), 1)"))
                       .select("text_key", "k", "cut", _at("tail_at", "tail_ids").alias("upto"), _at("head_at", "head_ids").alias("skip")), "seams")
        # ids of a text: all ids of its chunks, less what each seam cuts off on both sides
        ends = counted.join(seams, ["text_key", "k"], "left").select(
            "text_key", "doc_id", "n_bytes", F.coalesce("upto", "ids").alias("n"), (F.col("chunks") > F.col("k") + 1).alias("seam"), "upto")
        starts = seams.select("text_key", (-F.col("skip")).alias("n"))
        totals = (ends.groupBy("text_key", "doc_id", "n_bytes").agg(F.sum("n").alias("n"), F.bool_or(F.col("seam") & F.col("upto").isNull()).alias("open"))
                  .join(starts.groupBy("text_key").agg(F.sum("n").alias("less")), "text_key", "left"))
        done.append(totals.where("not open").select("doc_id", "n_bytes", (F.col("n") + F.coalesce("less", F.lit(0))).alias("n_tokens")))
        failed = seams.where(F.col("cut").isNull())
        if failed.isEmpty():
            break
        todo = stored(todo.join(failed.select("text_key").distinct(), "text_key", "left_semi"), "long-texts")
        chunk, overlap = chunk * widen, overlap * widen
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


__all__ = ["MARGIN", "word_bounds", "count_tokens"]
