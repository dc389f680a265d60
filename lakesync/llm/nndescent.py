"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 4).

Build.  Distinct vectors are the nodes (copies are expanded at the end, so a
vector that a third of the rows have is one node).  Cells of random hyperplanes
give each node its first neighbours.  Then, round by round, a join sends the
vectors of each node's neighbours, and of the nodes that have it as neighbour,
to the node; among these, neighbours of neighbours, all near pairs are proposed
to each other, and every node keeps its ``degree`` nearest.  A list tells its new
entries from those of earlier rounds: two old members of a neighbourhood have met
before and aren't compared again, and a neighbourhood without a new member sends
no vectors.  The rounds end when
one of them changes at most the share ``SETTLED`` of all places in the lists, so
larger tables get as many rounds as they need.  A node that is a
neighbour of very many is dealt out over parts, so none gathers without bound.
All distances proposed in a task are reduced to the nearest per node before they
are shuffled.

Search.  A query keeps a beam of the nearest nodes seen.  In each round the
unexpanded nodes of the beam meet the graph in a join, their neighbours (both
directions) enter the beam, and the search ends when the beam holds no
unexpanded node.  Build and search measure single-precision vectors; the whole
final beam is then ranked by exact distance on the original ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesync.llm.common import grouped_rows, stored
from lakesync.llm.vectors import matrix_of, packed, rows_of, usable, widest
from lakesync.session import scratch_path

#: Members of a part of a neighbourhood that are compared with each other.
PART = 64
#: Rows of proposals that a task gathers before it reduces them.
HELD = 1 << 18
#: Bytes of vectors in a row of the search table, so that a batch of 10,000 rows stays small whatever the dimension.
WIDE = 1 << 12
#: Rows with lists that are turned into Python objects at a time.
ROWS = 64
#: Rows of a hyperplane cell.
CELL = 192
#: The graph is done when a round of local joins changes at most this share of the places of all lists.
SETTLED = 0.001


def nearest_lists(node: np.ndarray, other: np.ndarray, dist: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """The ``degree`` nearest distinct others of each node: (nodes, bounds, others, distances)."""
    return _nearest(node, other, dist, np.ones(len(node), np.int8), degree)[:4]


def _nearest(node: np.ndarray, other: np.ndarray, dist: np.ndarray, new: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """As ``nearest_lists``, then whether each entry is new: 1 if all its rows are."""
    # a pair's distance may differ in its last bits from task to task: the least counts
    order = np.lexsort((dist, other, node))
    node, other, dist, new = node[order], other[order], dist[order], new[order]
    first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])))) if len(node) else np.zeros(0, np.int64)
    new = np.minimum.reduceat(new, first) if len(first) else new
    node, other, dist = node[first], other[first], dist[first]
    order = np.lexsort((other, dist, node))
    node, other, dist, new = node[order], other[order], dist[order], new[order]
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    place = np.arange(len(node)) - np.repeat(start, np.diff(np.concatenate((start, [len(node)]))))
    keep = place < degree
    node, other, dist, new = node[keep], other[keep], dist[keep], new[keep]
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    return node[start], np.concatenate((start, [len(node)])), other, dist, new


_LISTS = "node long, others binary, dists binary, new binary"


def _flat(col: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many of them each row has."""
    size = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    bounds = np.frombuffer(col.buffers()[1], size)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    wide = np.dtype(kind).itemsize
    if bounds[-1] == bounds[0]:
        return np.zeros(0, kind), np.zeros(len(col), np.int64)
    return np.frombuffer(col.buffers()[2], kind, (bounds[-1] - bounds[0]) // wide, bounds[0]), np.diff(bounds) // wide


def _list_batch(node, other, dist, new, degree) -> pa.RecordBatch:
    nodes, bounds, other, dist, new = _nearest(node, other, dist, new, degree)
    cut = lambda v: pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer((bounds * v.itemsize).astype(np.int32).tobytes()), pa.py_buffer(v.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(nodes), cut(other), cut(dist), cut(new)], ["node", "others", "dists", "new"])


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows (or of each matrix of rows); in doubles, so that near copies far from zero stay apart."""
    x = x.astype(np.float64)
    own = (x * x).sum(-1)
    return np.maximum(own[..., :, None] + own[..., None, :] - 2 * x @ np.swapaxes(x, -1, -2), 0)


class _Proposals:
    def __init__(self, degree: int):
        self.degree, self.rows, self.count = degree, [], 0

    def add(self, ids: np.ndarray, x: np.ndarray, most: int, new: np.ndarray | None = None, known: list[np.ndarray] | None = None, far: np.ndarray | None = None) -> None:
        """Each member's ``most`` nearest among the members (distinct ids); two that aren't ``new`` are left out.

        ``known``, ``far``: each member's list and the distance that a new entry must be below (``ids`` ascend then)."""
        if len(ids) < 2 or new is not None and not new.any():
            return
        d = _squares(x).astype(np.float32)
        np.fill_diagonal(d, np.inf)
        if new is not None:
            d[np.ix_(~new, ~new)] = np.inf
        if known is not None:
            d[d >= far[:, None]] = np.inf
            row, other = np.repeat(np.arange(len(ids)), [len(k) for k in known]), np.concatenate(known)
            col = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
            met = ids[col] == other
            d[row[met], col[met]] = np.inf
        most = min(most, len(ids) - 1)
        col = np.argpartition(d, most - 1, 1)[:, :most]
        row = np.repeat(np.arange(len(ids)), most)
        col = col.ravel()
        dist = d[row, col]
        met = np.isfinite(dist)
        self.rows.append((ids[row[met]], ids[col[met]], dist[met]))
        self.count += int(met.sum())

    def batch(self) -> pa.RecordBatch:
        rows = self.rows or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        self.rows, self.count = [], 0
        node, other, dist = (np.concatenate(c) for c in zip(*rows))
        return _list_batch(node, other, dist, np.ones(len(node), np.int8), self.degree)


def _cells(dim: int, degree: int, planes: np.ndarray):
    """Nodes to one cell key per tree (signs of ``planes``: trees x bits x dim)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("v"), dim, np.float32)
                for t, plane in enumerate(planes):
                    bits = (x @ plane.T > 0).astype(np.int64) @ (1 << np.arange(plane.shape[0], dtype=np.int64)) if len(plane) else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bits * len(planes) + t), batch.column("node"), batch.column("v")], ["cell", "node", "v"])

    return run


def _near_in_cells(dim: int, degree: int):
    """All pairs of each run of at most 2 * CELL nodes of a cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Proposals(degree)
        for group in grouped_rows(batches, "part"):
            ids, x = group.column("node").to_numpy(), matrix_of(group.column("v").combine_chunks(), dim, np.float32)
            runs = max(1, len(ids) // CELL)
            for k in range(runs):
                out.add(ids[k::runs], x[k::runs], degree)
            if out.count > HELD:
                yield out.batch()
        yield out.batch()

    return run


def _merge_lists(degree: int):
    """The rows of a node, which follow each other, to one list.  A batch at a time: only the last node's rows are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            others, n = _flat(batch.column("others"), np.int64)
            rows = (np.repeat(batch.column("node").to_numpy(), n), others, _flat(batch.column("dists"), np.float32)[0], _flat(batch.column("new"), np.int8)[0])
            if held is not None:
                rows = tuple(np.concatenate(c) for c in zip(held, rows))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield _list_batch(*(c[:cut] for c in rows), degree)
            held = tuple(c[cut:].copy() for c in rows)
        if held is not None:
            yield _list_batch(*held, degree)

    return run


def _merged(proposed: DataFrame, degree: int, graph: DataFrame | None = None) -> DataFrame:
    """One list a node; entries of ``graph`` are old."""
    if graph is not None:
        proposed = proposed.unionByName(graph.withColumn("new", F.unhex(F.translate(F.hex("new"), "1", "0"))))
    return proposed.repartition("node").sortWithinPartitions("node").mapInArrow(_merge_lists(degree), _LISTS)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            others, n = _flat(batch.column("others"), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), n)), pa.array(others), pa.array(_flat(batch.column("new"), np.int8)[0])],
                                             ["node", "other", "new"])


def _reach(degree: int):
    """Each node's list and the distance that a new entry must be below: that of its last entry, if the list is full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dists, n = _flat(batch.column("dists"), np.float32)
                far = np.full(len(n), np.inf, np.float32)
                full = n >= degree
                far[full] = dists[np.cumsum(n)[full] - 1]
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("others"), pa.array(far)], ["member", "others", "far"])

    return run


def _local_joins(dim: int, degree: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Proposals(degree)
        for group in grouped_rows(batches, "part"):
            ids, new = group.column("member").to_numpy(), group.column("new").to_numpy() == 1
            x = matrix_of(group.column("v").combine_chunks(), dim, np.float32)
            others, n = _flat(group.column("others").combine_chunks(), np.int64)
            known, far = np.split(others, np.cumsum(n)[:-1]), group.column("far").to_numpy()
            runs = -(-len(ids) // (2 * PART))
            for k in range(runs):
                out.add(ids[k::runs], x[k::runs], most, new[k::runs], known[k::runs], far[k::runs])
            if out.count > HELD:
                yield out.batch()
        yield out.batch()

    return run


def build_graph(nodes: DataFrame, dim: int, degree: int = 24, trees: int = 6, most: int = 10, seed: int = 11) -> DataFrame:
    """(node, others, dists, new): the approximate ``degree`` nearest of each node of (node, v: floats).

    Local joins are repeated until one changes at most ``SETTLED`` of the places;
    every change brings a list nearer, so they end."""
    n = nodes.count()
    rng = np.random.default_rng(seed)
    bits = max(0, int(np.ceil(np.log2(max(1, n) / CELL))))
    planes = rng.normal(size=(trees if bits else 1, bits, dim)).astype(np.float32)
    # cells are uneven: dealt out in parts of about CELL nodes, in each tree by another hash, so that a cell all trees agree on is mixed too
    keyed = nodes.mapInArrow(_cells(dim, degree, planes), "cell long, node long, v binary")
    sizes = keyed.groupBy("cell").agg(F.greatest(F.lit(1), F.floor(F.count("*") / (4 * CELL))).alias("fan"))
    parts = keyed.join(stored(sizes, "cell-sizes"), "cell").withColumn("part", F.xxhash64("cell", F.pmod(F.xxhash64("cell", "node"), F.col("fan")))).withColumn("turn", F.xxhash64("node", "cell"))
    firsts = parts.select("part", "turn", "node", "v").repartition("part").sortWithinPartitions("part", "turn", "node").mapInArrow(_near_in_cells(dim, degree), _LISTS)
    graph = stored(_merged(firsts, degree), "graph")
    changed = 1.0
    while changed > SETTLED:
        edges = graph.mapInArrow(_edges, "node long, other long, new byte")
        indegree = edges.groupBy("other").agg(F.count("*").alias("n"))
        # a node's neighbourhood: its neighbours, and the nodes that have it as neighbour; a hub's are dealt out in parts
        known = edges.select(F.col("node").alias("center"), F.col("other").alias("member"), "new")
        back = edges.select(F.col("other").alias("center"), F.col("node").alias("member"), "new")
        fan = stored(indegree.select(F.col("other").alias("center"), F.ceil(F.col("n") / (4 * PART)).cast("int").alias("fan")).where("fan > 1"), "hubs")
        dealt = (back.join(fan, "center", "left").select("center", "member", "new", F.pmod(F.xxhash64("member"), F.coalesce("fan", F.lit(1))).cast("long").alias("salt"))
                 .unionByName(known.join(fan, "center", "left").select("center", "member", "new", F.expr("explode(sequence(0L, coalesce(fan, 1) - 1L)) AS salt"))))
        # ids only: each member once, and only parts with something new; the vectors follow these
        members = (dealt.select(F.xxhash64("center", "salt").alias("part"), "member", "new").repartition("part")
                   .groupBy("part", "member").agg(F.max("new").alias("new"))
                   .withColumn("fresh", F.max("new").over(Window.partitionBy("part"))).where("fresh = 1").drop("fresh"))
        # with its list, a member is proposed only what its list lacks and would take
        reach = graph.mapInArrow(_reach(degree), "member long, others binary, far float")
        lists = (nodes.withColumnRenamed("node", "member").join(reach, "member", "left")
                 .select("member", "v", F.coalesce("others", F.unhex(F.lit(""))).alias("others"), F.coalesce("far", F.lit(float("inf")).cast("float")).alias("far")))
        parts = (members.join(lists, "member").select("part", "member", "new", "v", "others", "far")
                 .repartition("part").sortWithinPartitions("part", "member"))
        proposed = parts.mapInArrow(_local_joins(dim, degree, most), _LISTS)
        graph = stored(_merged(proposed, degree, graph), "graph")
        fresh, places = graph.agg(F.sum(F.length(F.translate(F.hex("new"), "0", ""))), F.sum(F.octet_length("new"))).first()
        changed = (fresh or 0) / (places or 1)
    return graph


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubles to floats."""
    for batch in batches:
        if batch.num_rows:
            raw = batch.column("v").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("node"), rows_of(np.frombuffer(b"".join(raw)).reshape(len(raw), -1).astype(np.float32))], ["node", "v"])


def _objects(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch as Python objects, a few rows' lists at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield from zip(*(part.column(c).to_pylist() for c in names))


_BEAM = "query_id long, q binary, nodes binary, dists binary, open binary"


def _advance(beam: int, width: int):
    """Merge what a query has seen; marks the nearest unexpanded nodes for the next round.

    ``open``: 1 where a node of the beam is to be expanded now, 2 where it waits, 0 where it is done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for query, q, nodes, dists, opens in _objects(batch, "query_id", "q", "nodes", "dists", "open"):
                node = np.concatenate([np.frombuffer(x, np.int64) for x in nodes])
                dist = np.concatenate([np.frombuffer(x, np.float32) for x in dists])
                state = np.concatenate([np.frombuffer(x, np.int8) for x in opens])
                state = np.where(state == 1, 0, state)  # marked before: expanded by now
                order = np.lexsort((state, node))
                node, dist, state = node[order], dist[order], state[order]
                new = np.concatenate(([True], node[1:] != node[:-1]))
                node, dist, state = node[new], dist[new], state[new]
                order = np.lexsort((node, dist))[:beam]
                node, dist, state = node[order], dist[order], state[order].copy()
                state[np.flatnonzero(state == 2)[:width]] = 1
                out.append((query, q, node.tobytes(), dist.tobytes(), state.astype(np.int8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.binary()] * 4))], ["query_id", "q", "nodes", "dists", "open"])

    return run


def _to_expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for query, q, nodes, opens in zip(*(batch.column(c).to_pylist() for c in ("query_id", "q", "nodes", "open"))):
            node = np.frombuffer(nodes, np.int64)[np.frombuffer(opens, np.int8) == 1]
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(node), pa.int64()), pa.array([q] * len(node), pa.binary()), pa.array(node)], ["query_id", "q", "node"])


def _expand(dim: int):
    """Distances of a query to the neighbours of one node of its beam."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dists, state = [], []
            for q, vecs in _objects(batch, "q", "vecs"):
                x = np.frombuffer(vecs, np.float32).reshape(-1, dim) - np.frombuffer(q, np.float32)
                dists.append((x * x).sum(1).astype(np.float32).tobytes())
                state.append(b"\x02" * len(x))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), batch.column("ids"), pa.array(dists, pa.binary()), pa.array(state, pa.binary())],
                                             ["query_id", "q", "nodes", "dists", "open"])

    return run


def _packed_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 16 * ROWS):
            rows = [(n, np.array(i, np.int64).tobytes(), b"".join(v)) for n, i, v in _objects(batch.slice(at, 16 * ROWS), "node", "ids", "vs")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["node", "ids", "vecs"])


def search_table(graph: DataFrame, nodes: DataFrame, dim: int, name: str | None = None) -> DataFrame:
    """(node, ids, vecs): each node's neighbours in both directions with their vectors.

    Written in the shared folder as a table bucketed by node, so the rounds of a
    search shuffle only their queries; ``forget`` takes it out of the catalog.  A
    node's neighbours come in several rows of about ``WIDE`` bytes of vectors."""
    spark = graph.sparkSession
    most = max(1, WIDE // (4 * dim))
    edges = graph.mapInArrow(_edges, "node long, other long, new byte").select("node", "other")
    both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    fan = stored(both.groupBy("node").agg(F.ceil(F.count("*") / most).cast("int").alias("fan")).where("fan > 1"), "hubs")
    name = name or f"ann_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # one shuffle by node serves the grouping and the buckets
    full = (both.join(nodes.withColumnRenamed("node", "other"), "other").join(fan, "node", "left").repartition(buckets, "node")
            .groupBy("node", F.pmod(F.xxhash64("other"), F.coalesce("fan", F.lit(1))).alias("part"))
            .agg(F.collect_list("other").alias("ids"), F.collect_list("v").alias("vs")))
    (full.select("node", "ids", "vs").mapInArrow(_packed_neighbours, "node long, ids binary, vecs binary")
     .write.bucketBy(buckets, "node").format("parquet").option("path", scratch_path(spark, "neighbours")).saveAsTable(name))
    return spark.table(name)


def forget(spark: SparkSession, name: str) -> None:
    """Drop a search table's entry; its files lie with the other intermediate data."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def search(table: DataFrame, starts: DataFrame, dim: int, beam: int = 448, width: int = 112) -> DataFrame:
    """Greedy search: (query_id, node, square) of each query's final beam, nearest by the squared distance of the floats.

    ``starts``: (query_id, q, node, square): where each query begins.  The search
    ends by itself: what falls out of a beam is farther than all in it, so a
    query expands no node twice."""
    first = starts.groupBy("query_id", "q").agg(F.collect_list("node").alias("n"), F.collect_list("square").alias("s"))

    def begin(batches):
        for batch in batches:
            if batch.num_rows:
                n, s = batch.column("n").to_pylist(), batch.column("s").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array([np.array(x, np.int64).tobytes() for x in n], pa.binary()),
                                                  pa.array([np.array(x, np.float32).tobytes() for x in s], pa.binary()), pa.array([b"\x02" * len(x) for x in n], pa.binary())],
                                                 ["query_id", "q", "nodes", "dists", "open"])

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("query_id", "q").agg(*[F.collect_list(c).alias(c) for c in ("nodes", "dists", "open")]).mapInArrow(_advance(beam, width), _BEAM)

    state = stored(gathered(first.mapInArrow(begin, _BEAM)), "beams")
    while not state.where(F.hex("open").contains("01")).isEmpty():  # a byte 1: something to expand
        now = state.mapInArrow(_to_expand, "query_id long, q binary, node long")
        seen = now.join(table.hint("merge"), "node").select("query_id", "q", "ids", "vecs").mapInArrow(_expand(dim), _BEAM)
        state = stored(gathered(state.unionByName(seen)), "beams")

    def rows(batches):
        for batch in batches:
            for query, nodes, dists in zip(*(batch.column(c).to_pylist() for c in ("query_id", "nodes", "dists"))):
                node = np.frombuffer(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([query] * len(node), pa.int64()), pa.array(node), pa.array(np.frombuffer(dists, np.float32).astype(np.float64))],
                                                 ["query_id", "node", "square"])

    return state.mapInArrow(rows, "query_id long, node long, square double")


def _exact(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = matrix_of(batch.column("q"), dim) - matrix_of(batch.column("v"), dim)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(np.sqrt((d * d).sum(1)))], ["query_id", "vec_id", "score"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, degree: int = 24, beam: int = 448, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each query by Euclidean distance, ties to the smaller vec_id.

    ``queries`` are rows of ``vectors``; a row's own id is no candidate of it.
    Null, empty and zero vectors, those with a null or non-finite component and
    null ids take no part; shorter vectors are padded with zeros; repeated rows
    (id and vector) count once.  No rows: no result."""
    spark = vectors.sparkSession
    ok = usable(F.col(vec_col)) & F.exists(vec_col, lambda x: x != 0) & F.col(id_col).isNotNull()
    clean, asked = vectors.where(ok), queries.where(ok)
    dim = widest(clean, vec_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # copies are one node; of a node's members the k + 1 least ids are all that can be asked for
    members = Window.partitionBy("v").orderBy("id")
    rows = stored(packed(clean, id_col, vec_col, dim).distinct().withColumn("place", F.row_number().over(members)).where(F.col("place") <= k + 1), "members")
    firsts = rows.where("place = 1").select(F.col("id").alias("node"), "v")
    nodes = stored(firsts.mapInArrow(_singles, "node long, v binary"), "nodes")
    graph = build_graph(nodes, dim, max(degree, k + 1))
    name = f"ann_{uuid.uuid4().hex}"
    table = search_table(graph, nodes, dim, name)
    # a query begins at its own node
    ask = stored(packed(asked, id_col, vec_col, dim).distinct().withColumnRenamed("id", "query_id")
                 .join(firsts.select("node", "v"), "v").select("query_id", F.col("v").alias("q"), "node"), "queries")
    begun = ask.join(nodes, "node").select("query_id", F.col("v").alias("q"), "node", F.lit(0.0).alias("square"))
    # a query id with several vectors is searched for each of them
    found = search(table, begun, dim, max(beam, 2 * k))  # its beams are written: the table is done with
    forget(spark, name)
    of_node = rows.join(firsts, "v").select("node", F.col("id").alias("vec_id"), "v")
    candidates = found.select("query_id", "node").distinct().join(of_node, "node").where("vec_id <> query_id").join(ask.select("query_id", "q"), "query_id")
    scored = candidates.select("query_id", "q", "vec_id", "v").mapInArrow(_exact(dim), "query_id long, vec_id long, score double")
    best = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["nearest_lists", "build_graph", "search_table", "search", "forget", "knn"]
