"""Suffix de-duplication by a common-prefix-aware distributed merge sort (operator 6).

A byte is removed when a ``length``-byte string that covers it also starts in a
document with a smaller id.

1. Anchors.  The window of ``length`` bytes from each position is filed under the
   least-hashed (leftmost) of its grams; consecutive windows under one gram form a
   segment.  Equal windows have equal grams at equal places, so only segments
   whose gram occurs in several documents can matter.  Gram hashes are exchanged
   as packed sorted runs, and a slice of texts learns as one bit a gram and
   document which of them others have too.
2. Suffix runs.  Each task sorts the suffixes that start at its shared anchors
   (a suffix ends with its segment; the segment's bytes before the anchor follow
   it), joins equal ones, and writes a front-coded run: the length of the prefix
   shared with the suffix before, and the rest.  Runs are cut at sampled
   splitters no longer than a gram, so suffixes of one gram meet in one range.
3. Merge.  A loser tree merges the runs of a range.  Every head carries the
   prefix it shares with the last winner, which the run's code provides, and
   bytes within a known common prefix are never compared again.  Suffixes of one
   gram come out side by side; if they are one string, its least document
   decides, otherwise their windows are looked up one by one.
4. Spans return to their documents.

Exact copies: all but the least id are covered whole; these are found by digest
and take no part in the sort.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import byte_slices, grouped_rows, passing, stored, text_bytes, unzipped, zipped
from lakesync.llm.textops import gram_hashes, mix, window_min

_GONE = np.uint64(0xFFFFFFFF)
_DOC = np.uint64(0xFFFF)
#: Bytes of suffixes that a task sorts at a time.
RUN_BYTES = 24 << 20


def segments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, gram hash) of all segments, places in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data, gram)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    # order by hash, then place: the leftmost of equal ones
    ranked = (hashes & ~_GONE) | np.arange(len(hashes), dtype=np.uint64)
    anchor = window_min(ranked, length - gram + 1) & _GONE
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):  # windows that leave their text
        anchor[max(a, b - length + 1):b] = _GONE
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
    at = anchor[first]
    inside = at != _GONE
    at = at[inside].astype(np.int64)
    return first[inside], last[inside], at, hashes[at]


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose rows are the runs of ``values`` between the bounds."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _planes(values: np.ndarray) -> bytes:
    """Sorted or small 64-bit numbers, byte by byte from the highest: the high bytes hardly change and compress away."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


SLICE = 2 << 20  # bytes of text hashed at a time
BUCKET = 8 << 20  # bytes of text whose grams, and whose suffixes, one task compares


_SLICES = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("hashes", pa.binary()), ("lens", pa.binary()), ("body", pa.binary())])
_SLICES_DDL = "slice long, kind int, ids binary, hashes binary, lens binary, body binary"
_BITS_DDL = "slice long, kind int, bucket int, body binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, hash, text) as slices of about ``SLICE`` bytes; a slice names its documents by 16 bits."""
    task, number, zip_ = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for own in (part for at in range(0, batch.num_rows, 1 << 16) for part in byte_slices(batch.slice(at, 1 << 16), "text", SLICE)):
            data, bounds = text_bytes(own.column("text"))
            row = [(task << 32) + number, 0, own.column("doc_id").to_numpy().tobytes(), own.column("hash").to_numpy().tobytes(), np.diff(bounds).tobytes(), zip_.compress(data)]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SLICES)], schema=_SLICES)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct documents of each slice."""
    for batch in batches:
        for number, ids in zip(batch.column("slice").to_pylist(), batch.column("ids").to_pylist()):
            doc = np.unique(np.frombuffer(ids, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.full(len(doc), number, np.int64))], ["doc_id", "slice"])


class _Slice:
    """The texts of a slice, and the entries (48 bits of a gram's hash, 16 bits of document) of its segments."""

    def __init__(self, row: dict):
        self.ids, self.hashes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["hashes"], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(np.frombuffer(row["lens"], np.int64))))
        raw = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(self.bounds[-1])))
        self.data = np.frombuffer(raw, np.uint8)

    def segments(self, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """(first window, last window, anchor, entry)."""
        first, last, at, hashes = segments(self.data, self.bounds, length, gram)
        doc = np.searchsorted(self.bounds, at, side="right") - 1
        return first, last, at, (hashes >> np.uint64(16) << np.uint64(16)) | doc.astype(np.uint64)

    def entries(self, entry: np.ndarray) -> np.ndarray:
        """The distinct entries, ascending; of copies in the slice, those of the least id alone."""
        order = np.argsort(self.ids, kind="stable")
        once = np.zeros(len(self.ids), bool)
        once[order[np.unique(self.hashes[order], return_index=True)[1]]] = True
        entry = np.unique(entry)
        return entry[once[(entry & _DOC).astype(np.int64)]]


def _limits(entry: np.ndarray, buckets: int) -> np.ndarray:
    """Where the entries of each bucket begin, and the end."""
    limits = ((np.arange(buckets, dtype=np.float64) / buckets) * 2.0 ** 48).astype(np.uint64)
    return np.concatenate((np.searchsorted(entry, limits << np.uint64(16)), [len(entry)]))


def _gram_runs(length: int, gram: int, buckets: int):
    """Per slice and bucket: sorted entries, their documents renumbered, and the documents' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = _Slice(row)
                entry = own.entries(own.segments(length, gram)[3])
                cut = _limits(entry, buckets)
                out, names, which = [], [], []
                for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                    part = entry[cut[k]:cut[k + 1]]
                    used, new = np.unique((part & _DOC).astype(np.int64), return_inverse=True)
                    out.append(_planes((part & ~_DOC) | new.astype(np.uint64)))
                    names.append(_planes(own.ids[used]))
                    which.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]] * len(which), pa.int64()), pa.array(which, pa.int32()), pa.array(out, pa.binary()), pa.array(names, pa.binary())],
                                                 ["slice", "bucket", "entries", "docs"])

    return run


def _shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: back to each slice one bit an entry, set where another document has the gram too."""
    for group in grouped_rows(batches, "bucket"):
        entries = [_from_planes(e) for e in group.column("entries").to_pylist()]
        names = [_from_planes(d).view(np.int64) for d in group.column("docs").to_pylist()]
        ids = np.concatenate([n[(e & _DOC).astype(np.int64)] for n, e in zip(names, entries)])
        ends = np.cumsum([len(e) for e in entries]).tolist()
        grams = np.concatenate(entries) >> np.uint64(16)
        del entries
        order = np.argsort(grams, kind="stable")
        grams, ids = grams[order], ids[order]
        start = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        several = np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)
        bit = np.zeros(len(grams), bool)
        bit[order] = np.repeat(several, np.diff(np.concatenate((start, [len(grams)]))))
        zip_ = zstandard.ZstdCompressor(level=1)
        body = [zip_.compress(np.packbits(bit[a:b]).tobytes()) for a, b in zip([0, *ends], ends)]
        yield pa.RecordBatch.from_arrays([group.column("slice").combine_chunks(), pa.array([1] * len(body), pa.int32()), group.column("bucket").combine_chunks(), pa.array(body, pa.binary())],
                                         ["slice", "kind", "bucket", "body"])


def _shared_entries(entry: np.ndarray, bits: list[dict], buckets: int) -> np.ndarray:
    """The entries whose returned bit is set."""
    cut, keep = _limits(entry, buckets), np.zeros(len(entry), bool)
    for r in bits:
        a, b = cut[r["bucket"]], cut[r["bucket"] + 1]
        keep[a:b] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["body"]), np.uint8), count=b - a).astype(bool)
    return entry[keep]


def shared_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    most = min(len(a), len(b))
    if a[start:most] == b[start:most]:
        return most
    low, high = start, most  # equal up to low, different before high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(shared prefix lengths, rest lengths, rests) of sorted keys of at most 255 bytes."""
    shared, rest, last = bytearray(), [], b""
    for key in keys:
        n = shared_prefix(last, key, 0)
        shared.append(n)
        rest.append(key[n:])
        last = key
    return bytes(shared), bytes(map(len, rest)), b"".join(rest)


def merge_runs(runs: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, run, place in the run, prefix shared with the key before) in key order, by a loser tree.

    ``known[r]`` is the prefix that the head of run ``r`` shares with the last
    winner; a longer one wins without a comparison, equal ones are compared from
    there on."""
    width = 1
    while width < len(runs):
        width *= 2
    head: list[bytes | None] = [None] * width
    known, place, begin = [0] * width, [0] * width, [0] * width
    for r, (_, rest, rests) in enumerate(runs):
        if rest:
            head[r], begin[r] = rests[:rest[0]], rest[0]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if head[a] is None:
            return b, a
        if head[b] is None:
            return a, b
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        one, two = head[a], head[b]
        n = shared_prefix(one, two, x)
        if one[n:n + 1] < two[n:n + 1] or (n == len(one) and n == len(two) and a < b) or (n == len(one) and n < len(two)):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers, winners = [0] * width, list(range(width))
    level = width
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            w, lost = play(winners[2 * i], winners[2 * i + 1])
            losers[level + i] = lost
            nxt.append(w)
        winners = nxt
    w = winners[0]
    while head[w] is not None:
        key = head[w]
        yield key, w, place[w], known[w]
        shared, rest, rests = runs[w]
        i = place[w] = place[w] + 1
        if i < len(rest):
            known[w] = shared[i]
            head[w] = key[:shared[i]] + rests[begin[w]:begin[w] + rest[i]]
            begin[w] += rest[i]
        else:
            head[w] = None
        node = (w + width) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2


_RUNS = pa.schema([("range", pa.int32()), ("shared", pa.binary()), ("rest", pa.binary()), ("rests", pa.binary()), ("counts", pa.binary()),
                   ("of", pa.binary()), ("docs", pa.binary()), ("hashes", pa.binary()), ("starts", pa.binary())])
_RUNS_DDL = "range int, shared binary, rest binary, rests binary, counts binary, of binary, docs binary, hashes binary, starts binary"


class _Run:
    """Suffixes of a task until they are written as one front-coded run."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = splitters
        self.clear()

    def clear(self):
        self.keys, self.texts, self.of, self.starts, self.size = [], [], [], [], 0

    def add(self, text: bytes, doc: int, text_hash: int, first, last, at, length: int) -> None:
        for i, j, a in zip(first, last, at):
            # the suffix from the anchor, what precedes it, and where the two meet
            self.keys.append(text[a:j + length] + text[i:a] + bytes((j + length - a,)))
        self.of += [len(self.texts)] * len(first)
        self.texts.append((doc, text_hash))
        self.starts += first
        self.size += 2 * length * len(first)

    def batch(self) -> pa.RecordBatch:
        order = sorted(range(len(self.keys)), key=self.keys.__getitem__)
        names = np.array(self.texts, np.int64).reshape(-1, 2)
        of = np.array(self.of, np.int64)[order]
        starts = np.array(self.starts, np.uint32)[order]
        keys, begin, last = [], [], None
        for i, o in enumerate(order):
            key = self.keys[o]
            if key != last:
                keys.append(key)
                begin.append(i)
                last = key
        begin = np.array(begin + [len(order)], np.int64)
        counts = np.diff(begin).astype(np.uint32)
        cut = [0] + [bisect_left(keys, s) for s in self.splitters] + [len(keys)]
        rows, zip_ = [], zstandard.ZstdCompressor(level=3)
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            if b > a:
                m, n = int(begin[a]), int(begin[b])
                used, new = np.unique(of[m:n], return_inverse=True)  # the documents of this piece of the run
                shared, rest, rests = front_code(keys[a:b])
                rows.append((k, shared, rest, zip_.compress(rests), counts[a:b].tobytes(), _planes(new), _planes(names[used, 0]), names[used, 1].tobytes(),
                             _planes(starts[m:n])))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)] if rows else [pa.array([], f.type) for f in _RUNS], schema=_RUNS)


def _suffix_runs(length: int, gram: int, splitters: list[bytes], buckets: int):
    """Rows of a slice follow each other: the slice, the bits of its entries (kind 1), the documents that need no search (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Run(splitters)
        for group in grouped_rows(batches, "slice"):
            rows = group.to_pylist()
            own = _Slice(rows[0])
            first, last, at, entry = own.segments(length, gram)
            shared = _shared_entries(own.entries(entry), [r for r in rows if r["kind"] == 1], buckets)
            needless = np.array([r["doc_id"] for r in rows if r["kind"] == 2], np.int64)
            shared = shared[~np.isin(own.ids[(shared & _DOC).astype(np.int64)], needless)]
            k = np.flatnonzero(np.isin(entry, shared))
            of = (entry[k] & _DOC).astype(np.int64)
            cut = np.searchsorted(of, np.arange(len(own.ids) + 1))  # segments come in the order of their documents
            for doc in np.flatnonzero(np.diff(cut)).tolist():
                own_k, base = k[cut[doc]:cut[doc + 1]], int(own.bounds[doc])
                out.add(own.data[base:own.bounds[doc + 1]].tobytes(), int(own.ids[doc]), int(own.hashes[doc]),
                        (first[own_k] - base).tolist(), (last[own_k] - base).tolist(), (at[own_k] - base).tolist(), length)
                if out.size > RUN_BYTES:
                    yield out.batch()
        yield out.batch()

    return run


class _Spans:
    def __init__(self):
        self.docs, self.hashes, self.places = [], [], []

    def add(self, doc: int, text_hash: int, start: int, end: int) -> None:
        self.docs.append(doc)
        self.hashes.append(text_hash)
        self.places.append(start << 32 | end)

    def batch(self) -> pa.RecordBatch:
        docs, hashes, places = np.array(self.docs, np.int64), np.array(self.hashes, np.int64), np.array(self.places, np.uint64)
        order = np.lexsort((places, hashes, docs))
        docs, hashes, places = docs[order], hashes[order], places[order]
        start = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])))) if len(docs) else np.zeros(0, np.int64)
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(docs[start]), pa.array(hashes[start]), _packed(places, np.concatenate((start, [len(docs)])))], ["doc_id", "hash", "places"])


def _judge(group: list, members, length: int, spans: _Spans) -> None:
    """``group``: (key, [(run, place)]) of one gram."""
    found = []
    for key, where in group:
        own = [m for r, i in where for m in members(r, i)]
        found.append((key, min(m[0] for m in own), own))
    least = min(f[1] for f in found)
    if len(found) == 1:
        for doc, text_hash, start in found[0][2]:
            if doc > least:
                spans.add(doc, text_hash, start, start + len(found[0][0]) - 1)
        return
    if all(m[0] == least for f in found for m in f[2]):
        return
    first: dict[bytes, int] = {}
    texts = []
    for key, doc, _ in found:
        n = key[-1]
        text = key[n:-1] + key[:n]
        texts.append(text)
        for p in range(len(text) - length + 1):
            window = text[p:p + length]
            if first.get(window, doc) >= doc:
                first[window] = doc
    for (_, _, own), text in zip(found, texts):
        mins = [first[text[p:p + length]] for p in range(len(text) - length + 1)]
        low = min(mins)
        for doc, text_hash, start in own:
            if doc <= low:
                continue
            begin = None
            for p, m in enumerate(mins):
                if m < doc:
                    begin = p if begin is None else begin
                elif begin is not None:
                    spans.add(doc, text_hash, start + begin, start + p - 1 + length)
                    begin = None
            if begin is not None:
                spans.add(doc, text_hash, start + begin, start + len(mins) - 1 + length)


def _merge(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_rows(batches, "range"):
            unzip = zstandard.ZstdDecompressor()
            runs = [(s, r, unzip.decompress(z)) for s, r, z in zip(*(table.column(c).to_pylist() for c in ("shared", "rest", "rests")))]
            counts = [np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()]
            ends = [np.cumsum(c).tolist() for c in counts]
            docs = [_from_planes(v).view(np.int64) for v in table.column("docs").to_pylist()]
            hashes = [np.frombuffer(v, np.int64) for v in table.column("hashes").to_pylist()]
            of, starts = ([_from_planes(v).astype(np.uint32) for v in table.column(c).to_pylist()] for c in ("of", "starts"))

            def members(r, i):
                a, b = ends[r][i - 1] if i else 0, ends[r][i]
                k = of[r][a:b]
                return zip(docs[r][k].tolist(), hashes[r][k].tolist(), starts[r][a:b].tolist())

            spans, group = _Spans(), []
            for key, r, i, known in merge_runs(runs):
                if group and known < gram:
                    _judge(group, members, length, spans)
                    group = []
                if group and known == len(key) == len(group[-1][0]):
                    group[-1][1].append((r, i))
                else:
                    group.append((key, [(r, i)]))
                if len(spans.docs) > 1 << 20:
                    yield spans.batch()
            if group:
                _judge(group, members, length, spans)
            yield spans.batch()

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for own in unzipped([batch]):
            spans, kept, size = [], [], []
            for raw, places in zip(own.column("text").to_pylist(), own.column("places").to_pylist()):
                size.append(len(raw))
                if not places:
                    spans.append([])
                    kept.append(raw)
                    continue
                place = np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in places]))
                start, end = (place >> np.uint64(32)).astype(np.int64), np.minimum((place & _GONE).astype(np.int64), len(raw))
                end = np.maximum.accumulate(end)
                new = np.concatenate(([True], start[1:] > end[:-1]))
                start, end = start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]
                spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
                kept.append(b"".join(raw[a:b] for a, b in zip([0] + end.tolist(), start.tolist() + [len(raw)])))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()),
                                              own.column("more")], ["doc_id", "n_bytes", "spans", "kept", "more"])


def splitters(docs: DataFrame, ranges: int, gram: int, sample: int = 4000) -> list[bytes]:
    """Cut strings of at most a gram's bytes, from one place of each of ``sample`` texts (the first by hash); they only balance the ranges."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - gram, F.lit(1))).cast("int") + 1
    rows = (docs.where(F.length("text") > gram).select(F.xxhash64("doc_id").alias("o"), F.col("text").substr(place, F.lit(8)).alias("piece"))
            .orderBy("o", "piece").limit(sample).collect())
    pieces = sorted(r.piece.encode()[:min(8, gram)] for r in rows)
    return sorted({pieces[i * len(pieces) // ranges] for i in range(1, ranges)}) if pieces else []


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: maximal removed runs of bytes), kept (the other bytes), then the columns ``keep``.

    Null texts are empty; texts below ``length`` bytes keep all.  Rows that repeat
    an id are the same document: they remove nothing of each other.  Rows without
    an id neither remove nor lose anything.  An empty table gives no rows.  A very
    long text is one slice: its task holds about 33 bytes of memory a byte of it.
    Other columns are ignored unless named in ``keep``."""
    if length < 16 or length > 120:
        raise ValueError("length must lie between 16 and 120")
    gram = length // 2 - 1
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"),
                        F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_")).alias("more"))
    own = whole.where("doc_id is not null").select("doc_id", "text", "hash")
    with passing(spark):
        rows = stored(own.select("doc_id", "hash", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n_bytes")), "digests")
        least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
        copies = stored(rows.join(least, "digest").select("doc_id", "hash", ((F.col("least") < F.col("doc_id")) & (F.col("n_bytes") >= length)).alias("copy")).distinct(), "copies")
        total = rows.agg(F.sum("n_bytes")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
        slices = stored(own.mapInArrow(_cut, _SLICES_DDL), "slices")
        grams = slices.mapInArrow(_gram_runs(length, gram, buckets), "slice long, bucket int, entries binary, docs binary")
        bits = grams.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_grams, _BITS_DDL)
        # a document that is a copy whole needs no search
        needless = copies.groupBy("doc_id").agg(F.bool_and("copy").alias("copy")).where("copy").select("doc_id")
        needless = slices.mapInArrow(_places, "doc_id long, slice long").join(needless, "doc_id").select("slice", F.lit(2).alias("kind"), "doc_id")
        cuts = splitters(own, buckets, gram)
        met = slices.unionByName(bits, allowMissingColumns=True).unionByName(needless, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "kind")
        runs = met.mapInArrow(_suffix_runs(length, gram, cuts, buckets), _RUNS_DDL)
        found = (runs.repartition(buckets, "range").sortWithinPartitions("range").mapInArrow(_merge(length, gram), "doc_id long, hash long, places binary"))
        every = copies.where("copy").select("doc_id", "hash", F.lit(np.uint64(_GONE).tobytes()).alias("places"))
        places = found.unionByName(every).groupBy("doc_id", "hash").agg(F.collect_list("places").alias("places"))
        places = stored(places, "places", outlives=True)
    rows = whole.select("doc_id", "text", "hash", "more")
    packed = rows.mapInArrow(zipped, rows.drop("text").withColumn("z", F.lit(None).cast("binary")).schema)
    joined = packed.join(places, ["doc_id", "hash"], "left")
    out = joined.select("doc_id", "z", "places", "more").mapInArrow(
        _kept, joined.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"),
                             F.lit(None).cast("binary").alias("kept"), "more").schema)
    return out.select("doc_id", "n_bytes", "spans", "kept", *[F.col("more")[c].alias(c) for c in keep])


__all__ = ["segments", "shared_prefix", "front_code", "merge_runs", "splitters", "remove_repeats"]
