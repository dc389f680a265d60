"""Repeated word passages by seeds: anchors exchanged first, then the windows that extend them.

A window of ``words`` consecutive words has one anchor, the least hash of its
grams of ``seed`` words (winnowing): equal windows have equal anchors, so two
documents that share a passage of a window's length meet on its anchors.

1. The texts are written once as slices of a few MB.  Every slice sends its
   distinct anchors; an anchor that two slices send is a seed.  A slice learns
   that as one bit an anchor, so neither texts nor places are exchanged.
2. A seed is extended both ways, by each window that has it as its anchor.  The
   slice sends (anchor, window) with the least document that holds it, and gets
   one bit back: a smaller document of another slice has it too.  The next
   anchor begins inside the reach of the last one, so matched windows chain up
   to maximal repeats, of any length.

What a slice holds many times it sends once.  A passage in a third of all
documents therefore costs its bucket one entry a slice, and no pair of
documents is ever formed.  A match needs the anchor and the window's own hash
alike, 128 bits together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import byte_slices, grouped_rows, stored
from lakesync.llm.textops import gram_hashes, mix, window_min

SLICE = 2 << 20  # bytes of text in a slice
BUCKET = 24 << 20  # bytes of text whose anchors share a bucket
_PIECE = 1 << 20  # bytes split into words at a time
_BLOCK = 1 << 18  # windows hashed at a time
_SPACES = b" \t\n\x0b\x0c\r"
_WINDOW = np.uint64(0x5851F42D4C957F2D)


def pieces(text: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """``text`` cut at white space into parts of about ``size`` bytes."""
    start = 0
    while start < len(text):
        stop = min(start + size, len(text))
        while stop < len(text) and text[stop] not in _SPACES:
            stop += 1
        yield text[start:stop]
        start = stop


def word_codes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word: a run of bytes other than ASCII white space."""
    parts = []
    for part in pieces(text):
        own = part.split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def windows(codes: np.ndarray, at: np.ndarray, words: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, text, anchor, hash) of every window inside one text, a block at a time; text i is ``codes[at[i]:at[i + 1]]``."""
    for base in range(0, len(codes) - words + 1, _BLOCK):
        part = codes[base:base + _BLOCK + words - 1]
        count = len(part) - words + 1
        first = np.arange(base, base + count)
        text = np.searchsorted(at, first, side="right") - 1
        inside = at[text + 1] >= first + words
        anchor = window_min(mix(gram_hashes(part, seed)), words - seed + 1)[:count]
        own = mix(gram_hashes(part, words) ^ _WINDOW)
        yield first[inside], text[inside], anchor[inside], own[inside]


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(body: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint64).reshape(columns, -1)


def _cut(limit: int):
    """Rows (doc_id, text, more) as slices: ids, whether there is one, byte lengths, compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in byte_slices(batch, "text", limit):
                ids = part.column("doc_id")
                raw = [t.encode() for t in part.column("text").to_pylist()]
                lens = np.array([len(r) for r in raw], np.int64)
                row = {"slice": (task << 32) + number, "kind": 0, "size": int(lens.sum()),
                       "ids": ids.fill_null(0).to_numpy().tobytes(), "known": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), "lens": lens.tobytes(),
                       "body": zstandard.ZstdCompressor(level=3).compress(b"".join(raw)), "more": json.dumps(part.column("more").to_pylist())}
                number += 1
                yield pa.RecordBatch.from_pylist([row], _SLICES)

    return run


_SLICES = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("size", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("lens", pa.binary()),
                     ("body", pa.binary()), ("more", pa.string())])
_SLICES_DDL = "slice long, kind int, size long, ids binary, known binary, lens binary, body binary, more string"
_BITS = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
_BITS_DDL = "slice long, kind int, bucket int, body binary"


class _Slice:
    """The texts of one slice and their words."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        lens = np.frombuffer(row["lens"], np.int64)
        flat = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(lens.sum())))
        ends = np.cumsum(lens)
        self.texts = [flat[e - n:e] for n, e in zip(lens.tolist(), ends.tolist())]
        codes = [word_codes(t) for t in self.texts]
        self.at = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int64)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)

    def windows(self, words: int, seed: int):
        """Windows of the documents that have an id."""
        for first, text, anchor, own in windows(self.codes, self.at, words, seed):
            with_id = self.known[text]
            yield first[with_id], text[with_id], anchor[with_id], own[with_id]

    def anchors(self, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, ascending, and whether two documents of this slice hold one."""
        parts = [np.zeros((2, 0), np.uint64)]
        for _, text, anchor, _ in self.windows(words, seed):
            parts.append(_distinct(anchor, self.ids[text].view(np.uint64)))
        anchor, doc = _distinct(*np.concatenate(parts, axis=1))
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        starts = np.flatnonzero(new)
        return anchor[starts], np.diff(np.append(starts, len(anchor))) > 1

    def extended(self, words: int, seed: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (anchor, window) of the seeds and the least document that holds each, ordered by window and anchor."""
        parts = []
        for _, text, anchor, own in self.windows(words, seed):
            hit = _member(anchor, seeds)
            parts.append((anchor[hit], own[hit], self.ids[text[hit]]))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        anchor, own, doc = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((doc, anchor, own))
        anchor, own, doc = anchor[order], own[order], doc[order]
        new = _new(own, anchor)
        return anchor[new], own[new], doc[new]


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = _new(a, b)
    return np.stack((a[new], b[new]))


def _new(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a pair differs from the one before."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values) % np.uint64(buckets)).astype(np.int64)


def _sent(row_slice: int, key: np.ndarray, buckets: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """One row a bucket with the entries whose ``key`` falls in it, in their order."""
    bucket = _bucket(key, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [{"slice": row_slice, "kind": 0, "bucket": b, "body": _pack(*(a[order[cuts[b]:cuts[b + 1]]] for a in arrays))}
            for b in np.flatnonzero(np.diff(cuts)).tolist()]
    return pa.RecordBatch.from_pylist(rows, _BITS)


def _bits(rows: list[dict], key: np.ndarray, buckets: int) -> np.ndarray:
    """The returned bits of all buckets, in the order of ``key``."""
    bucket = _bucket(key, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = np.zeros(len(key), bool)
    for r in rows:
        mine = order[cuts[r["bucket"]]:cuts[r["bucket"] + 1]]
        out[mine] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["body"]), np.uint8), count=len(mine)).astype(bool)
    return out


def _send_anchors(words: int, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                anchor, _ = _Slice(row).anchors(words, seed)
                yield _sent(row["slice"], anchor, buckets, anchor)

    return run


def _judge(columns: int, kind: int, verdict):
    """Per bucket: all entries together, ``verdict`` of them, and one bit an entry back to each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_rows(batches, "bucket"):
            rows = group.to_pylist()
            bodies = [_unpack(r.pop("body"), columns) for r in rows]
            sizes = [b.shape[1] for b in bodies]
            bit = verdict(np.concatenate(bodies, axis=1))
            ends = np.cumsum(sizes).tolist()
            out = [{"slice": r["slice"], "kind": kind, "bucket": r["bucket"], "body": zstandard.ZstdCompressor(level=1).compress(np.packbits(bit[e - n:e]).tobytes())}
                   for r, n, e in zip(rows, sizes, ends)]
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_pylist(out[i:i + 4096], _BITS)

    return run


def _in_two(entries: np.ndarray) -> np.ndarray:
    """Anchors that more than one slice sent (a slice sends each once)."""
    _, place, count = np.unique(entries[0], return_inverse=True, return_counts=True)
    return count[place] > 1


def _earlier(entries: np.ndarray) -> np.ndarray:
    """(anchor, window) entries that a smaller document of another slice holds."""
    anchor, own, doc = entries[0], entries[1], entries[2].view(np.int64)
    order = np.lexsort((doc, anchor, own))
    starts = np.flatnonzero(_new(own[order], anchor[order]))
    least = np.repeat(doc[order[starts]], np.diff(np.append(starts, len(order))))
    out = np.zeros(len(order), bool)
    out[order] = least < doc[order]
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict], list[dict]]]:
    """Each slice with the bits returned for its anchors and its windows; rows are clustered by slice, the slice first."""
    for group in grouped_rows(batches, "slice"):
        rows = group.to_pylist()
        yield rows[0], [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == 2]


def _seeds(own: _Slice, bits: list[dict], words: int, seed: int, buckets: int) -> np.ndarray:
    anchor, local = own.anchors(words, seed)
    return anchor[local | _bits(bits, anchor, buckets)]


def _send_windows(words: int, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, first, _ in _slices(batches):
            own = _Slice(row)
            anchor, window, doc = own.extended(words, seed, _seeds(own, first, words, seed, buckets))
            yield _sent(row["slice"], window, buckets, anchor, window, doc.view(np.uint64))

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                  ("kept", pa.large_binary()), ("more", pa.string())])
_OUT_DDL = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept binary, more string"


def _kept_text(text: bytes, gone: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    out, at = [], 0
    for part in pieces(text):
        own = part.split()
        stay = ~gone[at:at + len(own)]
        at += len(own)
        if stay.any():
            out.append(b" ".join(own if stay.all() else [own[i] for i in np.flatnonzero(stay).tolist()]))
    return b" ".join(out)


def _remove(words: int, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, first, second in _slices(batches):
            own = _Slice(row)
            seeds = _seeds(own, first, words, seed, buckets)
            anchor, window, doc = own.extended(words, seed, seeds)
            earlier = _bits(second, window, buckets)
            change = np.zeros(len(own.codes) + 1, np.int32)
            for at, text, a, w in own.windows(words, seed):
                hit = np.flatnonzero(_member(a, seeds))
                if not len(hit):
                    continue
                place = _find(window, anchor, w[hit], a[hit])
                covered = earlier[place] | (doc[place] < own.ids[text[hit]])
                starts = at[hit[covered]]
                np.add.at(change, starts, 1)
                np.add.at(change, starts + words, -1)
            gone = np.cumsum(change)[:-1] > 0
            more = json.loads(row["more"])
            out = []
            for i, t in enumerate(own.texts):
                g = gone[own.at[i]:own.at[i + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                out.append({"doc_id": int(own.ids[i]) if own.known[i] else None, "n_words": len(g),
                            "spans": [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()], "kept": _kept_text(t, g), "more": more[i]})
            yield pa.RecordBatch.from_pylist(out, _OUT)

    return run


def _find(window: np.ndarray, anchor: np.ndarray, w: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Places of the pairs (w, a) in the distinct pairs (window, anchor), ordered; every pair is there."""
    place = np.searchsorted(window, w)
    # two anchors with one window hash lie side by side
    while len(off := np.flatnonzero(anchor[place] != a)):
        place[off] += 1
    return place


def _by_slice(*frames: DataFrame) -> DataFrame:
    first, *others = frames
    rows = first.withColumn("bucket", F.lit(0))
    for o in others:
        rows = rows.unionByName(o, allowMissingColumns=True)
    return rows.repartition("slice").sortWithinPartitions("slice", "kind")


def remove_repeats(docs: DataFrame, words: int = 13, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                   slice_bytes: int = SLICE, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_words, spans (array of start, end: maximal removed runs of words), kept (binary: the words that stay, joined by one space), then ``keep``.

    A word goes if a window of ``words`` words over it also starts in a document
    with a smaller id; windows are judged on the input.  Words are runs of bytes
    other than ASCII white space, unchanged.  ``keep`` names columns that are
    carried along as text.

    Null texts are empty: no words, nothing removed.  Texts shorter than a window
    keep all.  Rows that repeat an id are the same document and remove nothing of
    each other; rows without an id neither remove nor lose anything.  An empty
    table gives no rows.  A very long text is one slice; its words are hashed and
    joined in pieces.  Other columns are ignored, whatever their names."""
    if not 1 <= seed <= words:
        raise ValueError("seed must lie between 1 and words")
    more = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("_")))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), more.alias("more"))
    slices = stored(own.mapInArrow(_cut(slice_bytes), _SLICES_DDL), "slices")
    total = slices.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def judged(sent: DataFrame, columns: int, kind: int, verdict) -> DataFrame:
        met = sent.repartition("bucket").sortWithinPartitions("bucket")
        return stored(met.mapInArrow(_judge(columns, kind, verdict), _BITS_DDL), f"bits-{kind}")

    anchors = slices.mapInArrow(_send_anchors(words, seed, buckets), _BITS_DDL)
    first = judged(anchors, 1, 1, _in_two)
    extended = _by_slice(slices, first).mapInArrow(_send_windows(words, seed, buckets), _BITS_DDL)
    second = judged(extended, 3, 2, _earlier)
    out = _by_slice(slices, first, second).mapInArrow(_remove(words, seed, buckets), _OUT_DDL)
    kept = F.from_json("more", ", ".join(["_ int", *[f"c{i} string" for i in range(len(keep))]]))
    return out.select("doc_id", "n_words", "spans", "kept", *[kept[f"c{i}"].alias(c) for i, c in enumerate(keep)])


__all__ = ["pieces", "word_codes", "windows", "remove_repeats"]
