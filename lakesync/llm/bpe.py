"""Byte-level BPE encoding and decoding from a rank file (operator 2).

The rank file becomes a tokenizers BPE model: each byte is written as the
printable character of the byte table, every way to cut a token into two known
tokens is a merge, in the order of the ranks.  Encoding runs over Arrow batches;
decoding looks up the bytes of each id and joins them, so characters split over
several ids come together again before any text is made of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lakesync.llm.common import byte_slices, id_text
from lakesync.llm.tokens import byte_part_table, encode_column, loaded, spaced_parts

# what a worker holds at a time: parts with their ids, bytes of text to encode, ids to decode
_PARTS, _TEXT, _IDS = 250_000, 2 << 20, 1 << 18


def byte_table() -> list[str]:
    """The printable character of each byte: visible Latin-1 as itself, all others from U+0100 on."""
    visible = [b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    table = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def rank_tokenizer(path: str, pattern: str):
    """A tokenizers object that merges by the ranks of the file, each match of ``pattern`` apart."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_table()
    written = lambda token: "".join(chars[b] for b in token)
    ranks = read_ranks(path)
    merges = []
    for token, rank in ranks.items():
        cuts = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(rank, left, right, token, i) for left, right, i in cuts]
    merges.sort(key=lambda m: m[:3])
    tok = Tokenizer(models.BPE({written(t): r for t, r in ranks.items()}, [(written(t[:i]), written(t[i:])) for *_, t, i in merges]))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"),
                                                 pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


def _bytes_of_ids(path: str) -> pa.Array:
    def make():
        ranks = read_ranks(path)
        out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            out[rank] = token
        return pa.array(out, pa.large_binary())

    return loaded(("id bytes", path), make)


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), and with ``offsets`` the first UTF-8 byte of each id in its text.

    Null and empty texts have no ids; null and repeated ids are carried as they
    are, row by row; other columns are ignored."""
    schema = "doc_id long, ids array<int>" + (", starts array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = byte_part_table((ranks_path, pattern), lambda: rank_tokenizer(ranks_path, pattern), _PARTS)
        sizes = pc.fill_null(pc.binary_length(_bytes_of_ids(ranks_path)), 0).to_numpy(zero_copy_only=False) if offsets else None
        for batch in batches:
            for own in byte_slices(batch, "text", _TEXT):
                ids, bounds = encode_column(parts, own.column("text"), spaced_parts)
                columns = [own.column("doc_id"), _lists(bounds, ids)]
                if offsets:
                    end = np.cumsum(sizes[ids], dtype=np.int64)
                    begin = end - sizes[ids]
                    base = np.repeat(begin[np.minimum(bounds[:-1], max(0, len(ids) - 1))] if len(ids) else np.zeros(len(own), np.int64), np.diff(bounds))
                    columns.append(_lists(bounds, begin - base))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts"][:len(columns)])
                pa.default_memory_pool().release_unused()

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def id_slices(batch: pa.RecordBatch, limit: int = _IDS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` entries of ``ids`` (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with the decoded bytes of ``ids`` as ``decoded`` (null ids: no bytes).

    Bytes, not text: an id sequence cut inside a character is no valid UTF-8.
    ``decode(decoded, 'utf-8')`` in SQL gives the text."""
    schema = encoded.select("doc_id", "ids").schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of_ids(ranks_path)
        for batch in batches:
            for own in id_slices(batch):
                ids = own.column("ids")
                flat = ids.flatten()
                bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
                one = pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), table.take(flat.cast(pa.int64())))
                joined = pc.binary_join(one, pa.scalar(b"", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), ids, joined.cast(pa.binary())], ["doc_id", "ids", "decoded"])
                pa.default_memory_pool().release_unused()

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


__all__ = ["byte_table", "read_ranks", "rank_tokenizer", "encode", "id_slices", "decode"]
