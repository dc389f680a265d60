"""N-gram Jaccard join by PartEnum signatures (operator 8).

Two shingle sets with Jaccard similarity of at least ``percent`` / 100 lie in
the same size band or in neighbouring ones and differ in at most k shingles,
with k known from the band.  For each band the shingle domain is cut into
first-level partitions, so that one of them holds at most one difference, and
each of these into second-level partitions, of which all but one are then equal:
a signature for every choice that leaves one out (two second-level partitions;
three where k is small) is shared by every similar pair.

Sets, not documents, are joined: copies share a key and never meet in pairs.
Of the sets that share a signature each is paired with the least key only, and
the pairs that a parity sketch cannot exclude (its distance never exceeds the
true one) are verified on the whole sets.  Sets that remain in different
components are then compared inside their group, in cells of two blocks: the
members that the sketch leaves a possible partner in another component go with
their whole sets to the cell, which counts every intersection and unites as it
finds links.  A cell sends out fewer rows than it has members, so no link is
lost, no group is expanded and no near miss leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import byte_slices, grouped_rows, id_text, stored
from lakesync.llm.components import components
from lakesync.llm.textops import mix, shingle_hashes

#: Sets of one signature that are compared at a time.
BLOCK = 2048
#: Shingles that a signature keeps at least, if so many halvings of what it leaves out find them.
LEAST_KEPT, HALVINGS = 1, 4
#: The cells of up to so many sets go to one task for each center: a set is in many of them, and its rows compress if they travel together.
TOGETHER = 128
#: Marks the halves apart from the cells.
PATH = np.uint64(1 << 40)


def band_starts(percent: int, largest: int) -> np.ndarray:
    """Least size of each band; the partners of a size lie in its own band or the next one, as integers have it."""
    starts = [1, 2]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    return np.array(starts + [max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1)], np.int64)


def most_differences(total, percent: int):
    """The largest symmetric difference of two sets of ``total`` elements together that are similar."""
    return total * (100 - percent) // (100 + percent)


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set of hashes, the same for equal sets."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)))
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) + mix(np.diff(bounds).astype(np.uint64) + np.uint64(1)))


def signatures(values: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures and the set each belongs to; ``values`` sorted within each set.

    A signature that keeps fewer than ``LEAST_KEPT`` shingles would be shared by
    unlike sets.  Both sets of a pair that share it see so, and their one
    difference lies in what it leaves out: this is halved again, and either half
    joins what is kept."""
    n = np.diff(bounds)
    starts = band_starts(percent, int(n.max(initial=1)))
    band = np.searchsorted(starts, n, side="right") - 1
    keys = set_keys(values, bounds)
    owner = np.repeat(np.arange(len(n)), n)
    out, whose = [], []
    for tag in (band, band + 1):
        k = most_differences(2 * (starts[np.minimum(tag + 1, len(starts) - 1)] - 1), percent)
        second = np.where(k < 16, 3, 2)
        # sets that may not differ are similar to their copies alone: one signature, of the whole set
        alone = np.flatnonzero((n > 0) & (k == 0))
        out.append(mix(keys[alone] + tag[alone].astype(np.uint64)))
        whose.append(alone)
        first = np.where((n > 0) & (k > 0), (k + 2) // 2, 0)
        cells = first * second
        base = np.cumsum(cells) - cells
        # the cell and the place in it grow with the hash, so each cell is a run of the sorted sets
        inside = cells[owner] > 0
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values[inside]), dtype=np.uint64)))
        at = (values[inside] >> np.uint64(32)) * cells[owner[inside]].astype(np.uint64) + (base[owner[inside]].astype(np.uint64) << np.uint64(32))
        ends = np.cumsum(np.bincount((at >> np.uint64(32)).astype(np.int64), minlength=int(cells.sum())))
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        row = np.repeat(np.arange(len(n)), cells)
        place = (np.arange(len(row)) - base[row]).astype(np.uint64)
        own = mix(sums[ends] - sums[begins] + mix(place + np.uint64(1)))
        sizes = np.repeat(second, first)
        group = np.concatenate(([0], np.cumsum(sizes)))
        both = [np.add.reduceat(x, group[:-1]) if len(x) else x for x in (own, ends - begins)]
        rest, kept = np.repeat(both[0], sizes) - own, np.repeat(both[1], sizes) - (ends - begins)
        named = mix((tag[row].astype(np.uint64) << np.uint64(32)) + place)
        low, width, node = np.arange(len(row)).astype(np.uint64) << np.uint64(32), np.uint64(1 << 32), np.ones(len(row), np.uint64)
        for depth in range(HALVINGS + 1):
            done = kept >= LEAST_KEPT if depth < HALVINGS else np.ones(len(row), bool)
            out.append(mix(rest[done] + named[done]))
            whose.append(row[done])
            row, named, rest, kept, low, node = (x[~done] for x in (row, named, rest, kept, low, node))
            if not len(row):
                break
            width >>= np.uint64(1)
            a, b, c = (np.searchsorted(at, low + np.uint64(i) * width) for i in range(3))
            halves = [(rest + mix(sums[y] - sums[x] + mix(PATH + np.uint64(2) * node + np.uint64(i))), kept + y - x, low + np.uint64(1 - i) * width, np.uint64(2) * node + np.uint64(i))
                      for i, (x, y) in enumerate(((a, b), (b, c)))]
            rest, kept, low, node = (np.concatenate(x) for x in zip(*halves))
            row, named = np.concatenate((row, row)), np.concatenate((named, named))
    return np.concatenate(out), np.concatenate(whose)


def sketches(values: np.ndarray, bounds: np.ndarray, percent: int) -> list[bytes]:
    """Parity bits of each set, 16 or more for each difference allowed.

    A shingle flips one bit, so two sketches never differ in more bits than the
    sets differ in shingles; a longer sketch folds to a shorter one's length."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        bits = 64
        while bits < 16 * most_differences(2 * (b - a), percent):
            bits *= 2
        parity = np.bincount((values[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(parity.astype(np.uint8)).tobytes())
    return out


def _fold(sketch: np.ndarray, width: int) -> np.ndarray:
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def short_sketch(sketch: bytes) -> bytes:
    """The sketch folded to a quarter, 64 bits at least: tells most unlike sets apart for a quarter of the bytes."""
    return _fold(np.frombuffer(sketch, np.uint8)[None, :], max(8, len(sketch) // 4)).tobytes()


def possible(n_a, sketch_a: list[bytes], n_b, sketch_b: list[bytes], percent: int) -> np.ndarray:
    """Which pairs (position by position) the sizes and sketches cannot exclude."""
    n_a, n_b = np.asarray(n_a, np.int64), np.asarray(n_b, np.int64)
    ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    size_a, size_b = (np.fromiter(map(len, s), np.int64, len(s)) for s in (sketch_a, sketch_b))
    for pair in {(a, b) for a, b, k in zip(size_a.tolist(), size_b.tolist(), ok) if k}:
        at = np.flatnonzero(ok & (size_a == pair[0]) & (size_b == pair[1]))
        one, two = (np.frombuffer(b"".join([s[i] for i in at]), np.uint8).reshape(len(at), -1) for s in (sketch_a, sketch_b))
        apart = np.bitwise_count(_fold(one, min(pair)) ^ _fold(two, min(pair))).sum(1)
        ok[at] = apart <= most_differences(n_a[at] + n_b[at], percent)
    return ok


def _sets(batches, words):
    """Slices as (doc_id column, distinct values, bounds)."""
    for batch in batches:
        for own in byte_slices(batch, "text", 2 << 20):
            yield own.column("doc_id"), *shingle_hashes(own.column("text"), words)


def _doc_rows(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, bounds in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(set_keys(values, bounds).view(np.int64)),
                                              pa.array(own := sketches(values, bounds, percent), pa.binary()), pa.array(map(short_sketch, own), pa.binary())],
                                             ["doc_id", "n", "key", "sketch", "short"])

    return run


def _signature_rows(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, bounds in _sets(batches, words):
            keys = set_keys(values, bounds)
            # copies in one slice send their signatures once
            _, once = np.unique(keys, return_index=True)
            keep = np.zeros(len(keys), bool)
            keep[once] = True
            sig, whose = signatures(values, bounds, percent)
            sig, whose = sig[keep[whose]], whose[keep[whose]]
            for at in range(0, len(sig), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(sig[at:at + (1 << 18)].view(np.int64)),
                                                  pa.array(keys[whose[at:at + (1 << 18)]].view(np.int64))], ["sig", "key"])

    return run


def _excluded_out(percent: int):
    """Pairs with sizes and sketches; keeps what these cannot exclude."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, s_a, n_b, s_b = (batch.column(c).to_pylist() for c in ("n_a", "sketch_a", "n_b", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array(possible(n_a, s_a, n_b, s_b, percent)))

    return run


def _open_members(percent: int):
    """(deal, cell, key, component) of the sets in a cell that sizes and sketches leave a possible partner in another component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_rows(batches, "cell"):
            key, part, n = (group.column(c).to_numpy() for c in ("key", "component", "n"))
            order = np.argsort(n, kind="stable")
            key, part, n = key[order], part[order], n[order]
            sketch = group.column("sketch").take(pa.array(order)).to_pylist()
            width = min(map(len, sketch))
            short = np.concatenate([_fold(np.frombuffer(x, np.uint8)[None, :], width) for x in sketch])
            open_ = np.zeros(len(n), bool)
            for i in range(len(n) - 1):
                # partners at least as large, at most 100 / percent times; first by folded sketches, then by whole ones
                last = np.searchsorted(n, n[i] * 100 // percent, side="right")
                other = np.flatnonzero((part[i + 1:last] != part[i]) & ~(open_[i] & open_[i + 1:last])) + i + 1
                if len(other):
                    apart = np.bitwise_count(short[other] ^ short[i]).sum(1)
                    other = other[apart <= most_differences(n[i] + n[other], percent)]
                if len(other):
                    other = other[possible(np.full(len(other), n[i]), [sketch[i]] * len(other), n[other], [sketch[j] for j in other.tolist()], percent)]
                if len(other):
                    open_[i] = open_[other] = True
            if open_.any():
                deal, cell = (np.full(int(open_.sum()), group.column(c)[0].as_py()) for c in ("deal", "cell"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, cell, key[open_], part[open_])], ["deal", "cell", "key", "component"])

    return run


def united(key: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all members of a cell that links connect, at most one less than there are components.

    ``part`` is what is connected already.  Every set is compared, by its whole
    intersection, with all larger ones of other components that sizes allow."""
    order = np.argsort([len(v) for v in sets], kind="stable")
    key, root, sets = key[order], part[order].copy(), [sets[i] for i in order]
    n = np.array([len(v) for v in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(n)))
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    out = []
    for i in range(len(n) - 1):
        last = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
        if last <= i + 1 or (root[i + 1:last] == root[i]).all():
            continue
        own = flat[at[i]:at[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[at[i + 1]:at[last]]], at[i + 1:last] - at[i + 1])
        mark[own] = 0
        for j in (np.flatnonzero(100 * both >= percent * (n[i] + n[i + 1:last] - both)) + i + 1).tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((min(int(key[i]), int(key[j])), max(int(key[i]), int(key[j]))))
    return out


def _united(percent: int):
    """:func:`united` of every cell, from its members and their whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_rows(batches, "cell"):
            sets = [np.frombuffer(v, np.uint64) for v in group.column("set").to_pylist()]
            links = united(group.column("key").to_numpy(), group.column("component").to_numpy(), sets, percent)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _verified(percent: int):
    """Groups of one ``a`` (and salt): the row of its own set, and the sets of its partners."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, None
        for batch in batches:
            a, b = [], []
            for x, y, salt, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "salt", "set"))):
                values = np.frombuffer(raw, np.uint64)
                if y is None:
                    center, own = (x, salt), values
                    continue
                if center != (x, salt):
                    raise RuntimeError("a set is missing")
                both = len(np.intersect1d(own, values, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(values) - both):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class SetJoin:
    """The steps of one join over the texts of ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.docs, self.words, self.percent = docs, words, percent
        self.rows = stored(docs.mapInArrow(_doc_rows(words, percent), "doc_id long, n long, key long, sketch binary, short binary"), "set-rows")
        # one row for each distinct set
        self.sets = stored(self.rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short")), "sets")

    def shared(self) -> DataFrame:
        """(sig, key, center) of the signatures that several sets have; the center is the least key."""
        rows = self.docs.mapInArrow(_signature_rows(self.words, self.percent), "sig long, key long")
        own = Window.partitionBy("sig")
        return stored(rows.withColumns({"center": F.min("key").over(own), "most": F.max("key").over(own)})
                      .where("center <> most").select("sig", "key", "center").distinct(), "shared")

    def with_sets(self, pairs: DataFrame, sketch: str = "sketch") -> DataFrame:
        a = self.sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col(sketch).alias("sketch_a"))
        b = self.sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col(sketch).alias("sketch_b"))
        return pairs.join(a, "a").join(b, "b")

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and sketches cannot exclude; whole sketches travel for what short ones leave."""
        for sketch in ("short", "sketch"):
            pairs = stored(self.with_sets(pairs, sketch).mapInArrow(_excluded_out(self.percent), "a long, b long"), "close")
        return pairs

    def open_members(self, cells: DataFrame) -> DataFrame:
        """The rows (deal, cell, key, component) that :func:`_open_members` keeps, by short sketches and then by whole ones."""
        for sketch in ("short", "sketch"):
            rows = cells.join(self.sets.select("key", "n", F.col(sketch).alias("sketch")), "key")
            cells = stored(rows.repartition("deal").sortWithinPartitions("cell").mapInArrow(_open_members(self.percent), "deal long, cell long, key long, component long"), "members")
        return cells

    def whole_sets(self, keys: DataFrame) -> DataFrame:
        """(key, set) of the distinct ``keys``, made again from one text each."""
        # written, so that its size is known and few are broadcast instead of shuffling the texts
        wanted = stored(self.sets.join(keys, "key", "left_semi").select("key", F.col("least").alias("doc_id")), "wanted")
        words = self.words

        def whole(batches):
            for batch in batches:
                for own in byte_slices(batch, "text", 2 << 20):
                    values, bounds = shingle_hashes(own.column("text"), words)
                    keys = set_keys(values, bounds).view(np.int64)
                    yield pa.RecordBatch.from_arrays([own.column("key"), pa.array(keys), pa.array(
                        [values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["key", "found", "set"])

        # ids may repeat, or be missing: the key made from the text decides which row it is
        texts = self.docs.join(wanted, self.docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("key", "text")
        return stored(texts.mapInArrow(whole, "key long, found long, set binary").where("key = found").groupBy("key").agg(F.first("set").alias("set")), "whole-sets")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct ``pairs`` (a < b) that are similar, counted on the whole sets."""
        sets = self.whole_sets(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
        # the partners of a set are dealt out by a salt, 256 or so together
        fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("fan"))
        salted = pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int"))
        partners = salted.select("a", "b", "salt").join(sets.withColumnRenamed("key", "b"), "b").select("a", "b", "salt", "set")
        own = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("key", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "salt", "set")
        dealt = partners.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return dealt.mapInArrow(_verified(self.percent), "a long, b long")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(edges, components of keys): links enough to connect all that are connected."""
        shared = self.shared()
        stars = shared.where("key <> center").select(F.col("center").alias("a"), F.col("key").alias("b")).distinct()
        first = stored(self.verify(self.close(stars)), "links")
        parts = stored(components(first), "components")
        # groups whose sets are not all connected yet; the center has met each of them
        named = (shared.where("key <> center").select("sig", "key", "center").join(parts.withColumnRenamed("node", "key"), "key", "left")
                 .withColumn("component", F.coalesce("component", "key")))
        open_groups = (named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.min("center").alias("center"))
                       .where("lo <> hi").select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.when(F.col("m") <= TOGETHER, F.col("center")).alias("deal")))
        left = named.drop("center").join(open_groups, "sig").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        # a cell is a pair of blocks; each row goes to the cells of its block
        cells = left.select("deal", "key", "component", F.explode(F.expr(
            "transform(sequence(0, blocks - 1), x -> xxhash64(sig, least(x, block), greatest(x, block)))")).alias("cell")).withColumn("deal", F.coalesce("deal", "cell"))
        members = self.open_members(cells)
        dealt = members.drop("deal").join(self.whole_sets(members.select("key").distinct()), "key")
        second = stored(dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_united(self.percent), "a long, b long").distinct(), "links")
        edges = first.unionByName(second)
        return edges, stored(components(edges), "components")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their
    distinct ``words``-word shingles (a shorter text is one shingle).  A null,
    empty or wordless text has no shingles and links with nothing.
    component_id is the smallest doc_id reachable by links, the document's own
    included.  Rows with a null id take part but name no component; repeated ids
    are carried row by row; other columns are ignored."""
    if not 50 <= percent <= 99:
        raise ValueError("percent must lie between 50 and 99")
    join = SetJoin(id_text(docs, id_col, text_col), words, percent)
    _, parts = join.links()
    named = join.sets.select("key", "least").join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = named.join(least, "component").select("key", "component_id")
    # a set with more than a thousandth of all rows (fewer than a thousand sets are that large) is dealt out in parts
    many = join.rows.count() // 1000 + 1
    hot = F.broadcast(join.rows.where("n > 0").groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > many)
                      .select("key", F.ceil(F.col("m") / many).cast("int").alias("fan")))
    fan = F.coalesce("fan", F.lit(1))
    by_key = by_key.join(hot, "key", "left").select("key", "component_id", F.explode(F.sequence(F.lit(0), fan - 1)).alias("salt"))
    rows = join.rows.select("doc_id", "n", "key").join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), fan).cast("int"))
    return (rows.join(by_key, ["key", "salt"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


__all__ = ["band_starts", "most_differences", "set_keys", "signatures", "sketches", "possible", "SetJoin", "jaccard_components"]
