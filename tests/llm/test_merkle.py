"""The manifest against a plain recursive tree, and the append's witnesses."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lakesync.llm import merkle
from lakesync.llm.queries import MANIFEST_FIELDS, op12_manifest
from tests.llm.helpers import DOCS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """Root and, per leaf, its runs (place, digests of the run) level by level."""
    paths, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            paths[i].append((p % 8, nodes[p // 8 * 8:p // 8 * 8 + 8]))
            at[i] = p // 8
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return (nodes[0] if nodes else None), paths


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted result rows of the query."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, own in zip(groups[g], trees[g][1]):
            path = own + tops[k]
            low = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                low = (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))
            fold = leaf(low)
            for place, run in path:
                fold = h(*run[:place], fold, *run[place + 1:])
            proof = h(*[d for place, run in path for i, d in enumerate(run) if i != place])
            out.append((r[0], leaf(r), trees[g][0], root, proof, fold, fold == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS)
    df.withColumns({c: F.lit("extra") for c in ("rank", "grp", "n", "digest", "witness", "root", "salt")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in op12_manifest(spark, str(tmp_path)).collect()), key=repr)


def some_rows(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, i, i, i, i % 50]), rng.choice([None, "s", ""]), rng.choice(langs), rng.choice([None, i]),
             rng.choice([None, "", "Ab É 日本", f"Text {i}", "lower"])) for i in range(n)]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (9, [None]), (70, [None, "", "en", "É", "zz", "Z"]), (700, [f"l{i}" for i in range(20)])])
def test_equals_brute_force(spark, tmp_path, n, langs):
    rows = some_rows(n, langs)
    rows += rows[:3]  # repeated rows
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_more_than_one_block(spark, levels):
    """Small blocks: witnesses go through several passes, block roots are appended like leaves."""
    rows = some_rows(900, ["en", "en", "en", "de", None])
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], DOCS)
    out = merkle.checked(merkle.manifest(df, MANIFEST_FIELDS, levels=levels)).collect()
    got = sorted(((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex(), r.folded == r.root) for r in out), key=repr)
    assert got == sorted(((*r[:5], True) for r in brute(rows)), key=repr)


def test_full_blocks(spark, tmp_path):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(4096 + 5)] + [(i, "s", "de", 1, "x") for i in range(4096)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.checked(merkle.manifest(df, MANIFEST_FIELDS)).collect() == []


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 600])
def test_append(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    grown = merkle.Append()
    for d in leaves:
        grown.append(d)
    partial = [len(w) for w in grown.witness]
    assert partial[0] == sum(n >= 8 ** k for k in range(1, 5))  # open subtrees hold what is complete so far
    root = grown.close(merkle.levels_of(n))
    want, paths = tree([d.hex() for d in leaves])
    assert root.hex() == want
    for d, w, path in zip(leaves, grown.witness, paths):
        assert merkle.folded(d, b"".join(w)) == root
        assert merkle.siblings(b"".join(w)).hex() == "".join(x for place, run in path for i, x in enumerate(run) if i != place)
    assert merkle.folded(hashlib.sha256(b"?").digest(), b"".join(grown.witness[0])) != root
