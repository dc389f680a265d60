"""Merkle manifest of a table with inclusion witnesses, built by aligned appends.

Every row is a leaf.  The leaves of a group ascend by id; every eight nodes in
a row become their parent until one is left.  The group roots, in the order of
their groups, are the leaves of the last tree.

The table is sorted once by range over (group, id), so a group of any size is
spread over tasks, and the rows get their place by counts of the ranges.  The
places cut each group into aligned blocks of 8^4 nodes.  A task appends the nodes
of a block in their order: an open subtree holds the partial witnesses of its
members, and each completed run of siblings extends the witnesses of all members
of the eight subtrees that it closes.  Block roots are appends to the blocks of
the next pass, eight to the fourth times fewer.  Witnesses of the last pass go
back down, a row a block, and are joined behind those of the members.

Texts are read once; beyond their leaf only ids and digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import stored

FAN = 8
LEVELS = 4  # levels of one block


def parent(digests: list[bytes]) -> bytes:
    """sha256 of the digests as lowercase hex text, concatenated."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Append:
    """A tree that grows by appends; ``witness[i]`` lists, level by level, the siblings met by member i so far.

    A witness level is one byte place in the run, one byte number of siblings,
    and the siblings' 32-byte digests in their order."""

    def __init__(self):
        self.open: list[list[tuple[bytes, list[int]]]] = [[]]  # a level: nodes of its open run, each with its members
        self.witness: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        self.witness.append([])
        self._add(0, digest, [len(self.witness) - 1])

    def _add(self, level: int, digest: bytes, members: list[int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, members))
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        for place, (_, members) in enumerate(run):
            met = bytes((place, len(run) - 1)) + b"".join(digests[:place] + digests[place + 1:])
            for m in members:
                self.witness[m].append(met)
        self._add(level + 1, parent(digests), [m for _, members in run for m in members])

    def close(self, levels: int) -> bytes:
        """Complete the open runs of ``levels`` levels, the last ones with fewer nodes; the root."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def levels_of(nodes: int) -> int:
    """Levels until one node remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def folded(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and a witness give."""
    at = 0
    while at < len(witness):
        place, others = witness[at], witness[at + 1]
        split, stop = at + 2 + 32 * place, at + 2 + 32 * others
        leaf = hashlib.sha256((witness[at + 2:split] + leaf + witness[split:stop]).hex().encode()).digest()
        at = stop
    return leaf


def siblings(witness: bytes) -> bytes:
    """All digests of a witness, level by level, left to right."""
    at, out = 0, []
    while at < len(witness):
        stop = at + 2 + 32 * witness[at + 1]
        out.append(witness[at + 2:stop])
        at = stop
    return b"".join(out)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The leaf of a row: sha256 of its fields, binary."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def _numbered(rows: DataFrame, group: str, order: list[str], groups_too: bool = False) -> DataFrame:
    """``rows`` with ``rank`` (from 0 within the group, by ``order``) and ``n`` (the group's rows).

    The rows are written in ranges; a range is numbered as it is read, and what
    lies before it is the sum of a few counts.  ``salt`` divides rows that are
    alike.  With ``groups_too`` also ``grp`` (the group's own place) and
    ``groups`` (their number)."""
    keys = [group, *order, "salt"]
    salted = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "nodes")
    kept = rows.columns
    schema = rows.withColumns({"part": F.lit(0), "run": F.lit(0), "place": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, place, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            runs, places = [], []
            for value in batch.column(group).to_pylist():
                if number < 0 or value != last:
                    number, place, last = number + 1, 0, value
                runs.append(number)
                places.append(place)
                place += 1
            added = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(runs, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, [*kept, "part", "run", "place"])

    ordered = stored(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").mapInArrow(run, schema), "ordered")
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("k").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (ordered.groupBy("part", "run").agg(F.first(group).alias(group), F.count("*").alias("k"))
              .select("part", "run", group, before.alias("before"), F.sum("k").over(own).alias("n")))
    if groups_too:
        starts = stored(starts, "starts")
        names = _numbered(starts.select(group).distinct().withColumn("all", F.lit(0)), "all", [group])
        names = names.select(F.col(group).alias("name"), F.col("rank").alias("grp"), F.col("n").alias("groups"))
        starts = starts.join(names, F.col(group).eqNullSafe(F.col("name"))).drop("name")
    starts = stored(starts.drop(group), "starts")
    return ordered.join(starts, ["part", "run"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "run", "place", "before")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], dict | None]]:
    """The nodes of each block in order, and the row that came down to it; rows are clustered by group and block."""
    held: list[dict] = []
    upper = None
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["grp"], row["block"]) != (held[0]["grp"], held[0]["block"]) or upper and (row["grp"], row["block"]) != (upper["grp"], upper["block"]):
                yield held, upper
                held, upper = [], None
            if row["rank"] < 0:
                upper = row
            else:
                held.append(row)
    if held:
        yield held, upper


_NODES_DDL = "grp long, rank long, n long, digest binary"
_NODES = pa.schema([("grp", pa.int64()), ("rank", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])


def _tree(nodes: list[dict], levels: int) -> tuple[Append, bytes]:
    """The nodes of a block appended, and its root; a group of one block stops where one node remains."""
    tree = Append()
    for node in nodes:
        tree.append(node["digest"])
    return tree, tree.close(min(levels, levels_of(nodes[0]["n"])))


def _roots(levels: int):
    """The root of every block: a node of the next pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for nodes, _ in _blocks(batches):
            first = nodes[0]
            out.append({"grp": first["grp"], "rank": first["block"], "n": -(-first["n"] // FAN ** levels), "digest": _tree(nodes, levels)[1]})
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, _NODES)
                out = []
        yield pa.RecordBatch.from_pylist(out, _NODES)

    return run


def _block(levels: int) -> Column:
    return F.floor(F.col("rank") / FAN ** levels)


def _clustered(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "rank")


def _passes(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` (grp, rank, n, digest) and the block roots of each pass, until every group has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        own = out[-1].select("grp", "rank", "n", "digest").withColumn("block", _block(levels))
        out.append(stored(_clustered(own).mapInArrow(_roots(levels), _NODES_DDL), "roots"))
    return out


def _down(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with ``witness`` (their own block's levels, then those of its root) and the ``root`` of their group.

    ``upper``: (grp, rank of the block, witness, root)."""
    given = nodes.select("grp", "rank", "n", "digest", F.struct("*").alias("row"))
    came = upper.select("grp", F.lit(-1).cast("long").alias("rank"), F.col("rank").alias("block"), "witness", "root")
    cluster = _clustered(given.withColumn("block", _block(levels)).unionByName(came, allowMissingColumns=True))
    schema = cluster.select("row", "witness", "root").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        arrow = pa.schema([first.schema.field(c) for c in ("row", "witness", "root")])
        for members, above in _blocks(chain([first], batches)):
            tree, _ = _tree(members, levels)
            rows = [{"row": node["row"], "witness": b"".join(met) + above["witness"], "root": above["root"]} for node, met in zip(members, tree.witness)]
            for i in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_pylist(rows[i:i + 1024], arrow)

    return cluster.mapInArrow(run, schema).select("row.*", "witness", "root")


def witnessed(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (grp, rank, n, digest and any other columns) with ``witness`` and ``root`` of their group's tree."""
    passes = _passes(nodes, levels)
    upper = passes[-1].select("grp", "rank", F.lit(b"").alias("witness"), F.col("digest").alias("root"))
    for below in passes[-2:0:-1]:
        upper = stored(_down(below, upper, levels).select("grp", "rank", "witness", "root"), "witnesses")
    if len(passes) == 1:
        return nodes.withColumns({"witness": F.lit(b""), "root": F.col("digest")})
    return _down(nodes, upper, levels)


def manifest(docs: DataFrame, fields: tuple[str, ...], id_col: str = "doc_id", group_col: str = "lang", changed: tuple[Column, ...] = (), levels: int = LEVELS) -> DataFrame:
    """A row per row of ``docs``: doc_id, grp_value, leaf, changed_leaf, subroot, root, witness (all digests binary).

    ``fields`` are the columns of a leaf, in order.  ``changed``, one column a
    field, gives the row whose leaf is ``changed_leaf`` (none: the leaf itself).
    Blocks have 8^``levels`` nodes, whatever the tree.

    Within a group leaves ascend by id, those without an id first; rows that
    share an id are ordered by their leaf, so repeated rows give one tree
    whatever their order.  Null is a group of its own and the first.  Nulls in
    fields are marked apart from empty values.  A single row is its own
    subroot; an empty table gives no rows and has no root.  Other columns are
    ignored, whatever their names."""
    leaf = leaf_digest(*[F.col(c) for c in fields])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("grp_value"), leaf.alias("digest"),
                       (leaf_digest(*changed) if changed else leaf).alias("changed_leaf"))
    leaves = stored(_numbered(rows, "grp_value", ["doc_id", "digest"], groups_too=True), "leaves")
    passes = _passes(leaves, levels)
    # one node a group is left: the leaves of the tree of groups
    subroots = leaves.select("grp", "groups").distinct().join(passes[-1].select("grp", "digest"), "grp")
    top = stored(witnessed(stored(subroots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("rank"), F.col("groups").alias("n"), "digest"), "subroots"), levels), "top")
    upper = top.select(F.col("rank").alias("grp"), F.lit(0).cast("long").alias("rank"), "witness", F.struct(F.col("digest").alias("subroot"), "root").alias("root"))
    for below in passes[:0:-1]:
        upper = stored(_down(below, upper, levels).select("grp", "rank", "witness", "root"), "witnesses")
    return _down(leaves, upper, levels).select("doc_id", "grp_value", F.col("digest").alias("leaf"), "changed_leaf", F.col("root.subroot").alias("subroot"),
                                       F.col("root.root").alias("root"), "witness")


def checked(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`manifest` with ``proof`` (digest of the witness's siblings) and ``folded`` (the root that ``changed_leaf`` gives)."""
    schema = rows.withColumns({"proof": F.lit(None).cast("binary"), "folded": F.lit(None).cast("binary")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met, leaves = batch.column("witness").to_pylist(), batch.column("changed_leaf").to_pylist()
            added = [pa.array([hashlib.sha256(siblings(w).hex().encode()).digest() for w in met], pa.binary()),
                     pa.array([folded(leaf, w) for leaf, w in zip(leaves, met)], pa.binary())]
            yield pa.RecordBatch.from_arrays(batch.columns + added, [*batch.schema.names, "proof", "folded"])

    return rows.mapInArrow(run, schema)


__all__ = ["Append", "levels_of", "parent", "folded", "siblings", "field", "leaf_digest", "witnessed", "manifest", "checked"]
