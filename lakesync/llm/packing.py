"""Hierarchical multi-length packing (operator 1).

Documents become token ids, are routed to context-size tiers by what remains of
them after full windows of the longest tier, and are packed tier by tier; the
gap of a long window is filled with whole pieces of shorter tiers and, last, a
cut piece, so windows are exactly full.  Step groups hold sequences of one
tier and the same number of tokens.

Distribution: each map task packs the documents it reads (no shuffle of the
corpus) with a bounded pool.  What fills no window at its end, less than one
longest window, is exchanged with the leftovers of ``fan_in`` tasks and packed
once more.  Only the last window of such a group is padded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import byte_slices, id_text, stored
from lakesync.llm.tokens import encode_column, whitespace_parts, word_part_table

TIERS = (256, 512, 1024, 2048, 4096)

_PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
           "tier int, tier_seq long, packer long, ids binary")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("tier_seq", pa.int64()),
                    ("packer", pa.int64()), ("ids", pa.binary())])


class Packer:
    """Pools pieces per tier and emits exactly full windows.

    ``packer`` numbers the packer; a sequence id is ``packer << 32`` plus a
    running number, so ids are unique without coordination and the same when a
    lost task is run again."""

    def __init__(self, packer: int, tiers=TIERS, pool_windows: int = 64):
        self.packer, self.tiers, self.longest = packer, tuple(sorted(tiers)), max(tiers)
        self.pools = {t: deque() for t in self.tiers}
        self.size, self.limit = dict.fromkeys(self.tiers, 0), pool_windows * self.longest
        self.made, self.tier_made = 0, dict.fromkeys(self.tiers, 0)
        self.out: list[tuple] = []

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def route(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        """Full longest windows at once; the rest to its tier's pool."""
        while len(ids) >= self.longest:
            self._emit(self.longest, [(doc_id, start, ids[:self.longest], doc_tokens)])
            ids, start = ids[self.longest:], start + self.longest
        if len(ids):
            self._keep(doc_id, start, ids, doc_tokens)
        if sum(self.size.values()) > self.limit:
            self.pack()

    def _keep(self, doc_id, start, ids, doc_tokens) -> None:
        t = self.tier(len(ids))
        self.pools[t].append((doc_id, start, ids, doc_tokens))
        self.size[t] += len(ids)

    def _take(self, t: int) -> tuple:
        piece = self.pools[t].popleft()
        self.size[t] -= len(piece[2])
        return piece

    def pack(self) -> None:
        """Fill windows, longest tier first, until no window can be filled."""
        for t in reversed(self.tiers):
            while self.pools[t] and sum(n for s, n in self.size.items() if s <= t) >= t:
                self._fill(t)

    def _fill(self, t: int) -> None:
        window = [self._take(t)]
        gap = t - len(window[0][2])
        shorter = [s for s in reversed(self.tiers) if s <= t]
        for s in shorter:  # whole pieces
            while self.pools[s] and len(self.pools[s][0][2]) <= gap:
                window.append(self._take(s))
                gap -= len(window[-1][2])
        for s in reversed(shorter):  # then cuts, from the shortest tier up
            while gap and self.pools[s]:
                doc_id, start, ids, n = self._take(s)
                window.append((doc_id, start, ids[:gap], n))
                taken = len(window[-1][2])
                if taken < len(ids):
                    self._keep(doc_id, start + taken, ids[taken:], n)
                gap -= taken
        self._emit(t, window)

    def _emit(self, t: int, window: list[tuple]) -> None:
        offset, sequence = 0, (self.packer << 32) + self.made
        for doc_id, start, ids, n in window:
            self.out.append((doc_id, start, len(ids), n, sequence, offset, t, self.tier_made[t], self.packer, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.made += 1
        self.tier_made[t] += 1

    def rest(self) -> list[tuple]:
        """Pieces that filled no window, longest first."""
        left = [p for t in reversed(self.tiers) for p in self.pools[t]]
        self.pools, self.size = {t: deque() for t in self.tiers}, dict.fromkeys(self.tiers, 0)
        return left

    def close(self) -> None:
        """One last window, which is padded, for what is left."""
        left = self.rest()
        if left:
            self._emit(self.tier(sum(len(p[2]) for p in left)), left)

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows
                                          else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def _first_round(path: str, end_id: int | None, tiers: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = word_part_table(path)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            for own in byte_slices(batch, "text"):
                ids, bounds = encode_column(parts, own.column("text"), whitespace_parts)
                for doc_id, a, b in zip(own.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    one = np.concatenate((ids[a:b], end))
                    packer.route(doc_id, 0, one, len(one))
                yield packer.batch()
        packer.pack()
        yield packer.batch()
        # leftovers carry no sequence yet
        packer.out = [(d, s, len(i), n, None, None, None, None, packer.packer, i.astype("<u4").tobytes()) for d, s, i, n in packer.rest()]
        yield packer.batch()

    return run


def _second_round(tiers: tuple):
    def run(group: pa.Table) -> pa.Table:
        # packers of this round are numbered below zero, apart from task numbers
        packer = Packer(-1 - group.column("round_group")[0].as_py(), tiers)
        rows = group.sort_by([("packer", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        for doc_id, start, n, ids in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            packer.route(doc_id, start, np.frombuffer(ids, "<u4"), n)
        packer.pack()
        packer.close()
        return pa.Table.from_batches([packer.batch()])

    return run


#: Cases that tell whether cutting at white space, making lower case and splitting full stops and commas off keep the ids.
_PROBES = ("Ab cD", "a b", " a\tb\n\nc ", "End. Next, one", "x.y 1,5", "It's (so)!", "ÉÀ Straße", "日本 語")


def _check_tokenizer(path: str) -> None:
    """Refuse a tokenizer whose ids the word-wise encoding would change."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    parts = word_part_table(path)
    for text in _PROBES:
        want = library.encode(text, add_special_tokens=False).ids
        got, _ = encode_column(parts, pa.array([text]), whitespace_parts)
        if got.tolist() != want:
            raise ValueError(f"{path}: packing needs a tokenizer that makes texts lower case and drops white space; {text!r} has other ids")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, tiers: tuple = TIERS, step_tokens: int = 1 << 18,
         fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences; one row per piece of a document.

    Columns: doc_id, start (ids of the document before the piece), length,
    doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset (in the
    sequence, gapless from 0), tier (window size), step_group.  A sequence is
    padded to its tier only if it is the last of a leftover group.  Step groups
    number ``step_tokens`` tokens of one tier each; the last of a tier may be
    short.

    Null texts are empty; an empty text is its end id alone (no piece without
    ``end_id``).  Null or repeated ids are carried as they are, every row is a
    document of its own.  Other columns are ignored, whatever their names.

    Texts are encoded word by word, which holds for tokenizers that make them
    lower case and drop white space; one that shows otherwise is a ValueError."""
    _check_tokenizer(tokenizer_path)
    tiers = tuple(sorted(tiers))
    first = stored(id_text(docs, id_col, text_col).mapInArrow(_first_round(tokenizer_path, end_id, tiers), _PIECES), "packed")
    second = stored(first.where(F.col("sequence_id").isNull()).withColumn("round_group", F.floor(F.col("packer") / fan_in).cast("long"))
                    .groupBy("round_group").applyInArrow(_second_round(tiers), _PIECES), "packed-rest")
    pieces = first.where(F.col("sequence_id").isNotNull()).unionByName(second)
    # one row per packer and tier: where its sequences begin among those of the tier
    counts = pieces.groupBy("packer", "tier").agg((F.max("tier_seq") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("packer").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that its size is known and the pieces are not shuffled while it is small
    begins = stored(counts.select("packer", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "begins")
    steps = F.floor((F.col("begin") + F.col("tier_seq")) * F.col("tier") / step_tokens).cast("long")
    return (pieces.join(begins, ["packer", "tier"])
            .select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset", "tier",
                    F.struct("tier", steps.alias("step")).alias("step_group")))


__all__ = ["TIERS", "Packer", "pack"]
