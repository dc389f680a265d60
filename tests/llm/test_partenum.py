"""Operator 8 and its components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakesync.llm import partenum
from lakesync.llm.components import components
from lakesync.llm.textops import shingle_hashes

from .helpers import DOCS, awkward_texts, frame


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(rows, words, percent):
    """rows: (doc_id, text); {position: (size, component)}"""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def edited(rng, words, share):
    words = list(words)
    for _ in range(int(len(words) * share)):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def family_corpus(seed):
    """Exact and near copies at all distances, chains, shared passages, short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 40, 90, 250]))]
        texts += [" ".join(base)] * rng.choice([1, 1, 3])
        chain = base
        for _ in range(rng.choice([2, 6])):
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))))
            chain = edited(rng, chain, 0.02)
            texts.append(" ".join(chain).upper())
            texts.append(" ".join(base + passage))
            texts.append(" ".join(base[:int(len(base) * rng.choice([0.84, 0.86, 0.9]))]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("words,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 70, 3), (2, 95, 4)])
def test_components_equal_brute_force(spark, words, percent, seed):
    texts = family_corpus(seed) + awkward_texts(n=10)
    rows = list(enumerate(texts))
    got = partenum.jaccard_components(frame(spark, texts), words, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, words, percent))


def test_blocks_of_a_large_group(spark, monkeypatch):
    """Sets that share signatures and are not linked, dealt out in several blocks."""
    monkeypatch.setattr(partenum, "BLOCK", 3)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, s)) for s in (0.0, 0.02, 0.04, 0.06) for _ in range(8)]
    got = partenum.jaccard_components(frame(spark, texts), 2, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(list(enumerate(texts)), 2, 85))


def test_null_and_repeated_ids_and_empty(spark):
    rows = [(5, "a b c d e"), (5, "x y z"), (None, "a b c d e"), (2, "a b c d e"), (None, "only here once"), (None, None), (9, "")]
    df = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], DOCS)
    got = partenum.jaccard_components(df, 2, 85).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(key, brute(rows, 2, 85)))
    assert partenum.jaccard_components(df.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    """The guarantee itself: random pairs at the threshold, of every size."""
    rng = np.random.default_rng(1)
    for percent in (60, 80, 85, 95):
        for _ in range(150):
            n = int(rng.integers(1, 300))
            m = int(rng.integers(n, n * 100 // percent + 1))
            both = -(-percent * (n + m) // (100 + percent))
            if both > n:
                continue
            pool = np.unique(rng.integers(0, 1 << 63, 4 * (n + m), dtype=np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n:n + m - both])))
            sig, whose = partenum.signatures(np.concatenate((a, b)), np.array([0, n, n + m]), percent)
            assert set(sig[whose == 0].tolist()) & set(sig[whose == 1].tolist())
            sk = partenum.sketches(np.concatenate((a, b)), np.array([0, n, n + m]), percent)
            assert partenum.possible([n], sk[:1], [m], sk[1:], percent)[0]


def test_shingles_equal_brute_force():
    texts = [t or "" for t in awkward_texts(seed=2, n=60)]
    for n in (1, 3, 4, 5):
        values, bounds = shingle_hashes(pa.array(["skip"] + texts).slice(1), n)
        seen = {}
        for i, t in enumerate(texts):
            own = shingles(t, n)
            assert bounds[i + 1] - bounds[i] == len(own)
            seen[frozenset(own)] = seen.get(frozenset(own), set()) | {tuple(values[bounds[i]:bounds[i + 1]].tolist())}
        assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_star_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (999, 999)]
    rng.shuffle(edges)
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = components(spark.createDataFrame(edges * 2, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: root(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0 and F is not None


def test_cells_unite_what_links_connect():
    """Fewer links than members, and the components that all links give, also where near misses abound."""
    rng = np.random.default_rng(8)
    for percent in (80, 85):
        base = rng.choice(10_000, 60, replace=False).astype(np.uint64)
        sets = [base] + [np.unique(np.concatenate((rng.choice(base, 60 - d, replace=False), rng.choice(10_000, d).astype(np.uint64)))) for d in rng.integers(1, 12, 80)]
        sets += [np.array([1], np.uint64), np.array([1, 2], np.uint64)]
        key, part = rng.permutation(len(sets)) - 40, np.arange(len(sets)) - 7
        part[3] = part[5]
        links = partenum.united(key, part, sets, percent)
        same = {int(k): {int(k)} for k in key}
        for a, b in [*links, (int(key[3]), int(key[5]))]:
            both = same[a] | same[b]
            for k in both:
                same[k] = both
        want = {int(k): {int(k)} for k in key}
        for i, x in enumerate(sets):
            for j in range(i):
                inter = len(np.intersect1d(x, sets[j]))
                if 100 * inter >= percent * (len(x) + len(sets[j]) - inter) or {i, j} == {3, 5}:
                    both = want[int(key[i])] | want[int(key[j])]
                    for k in both:
                        want[k] = both
        assert same == want and len(links) < len(sets) and all(a < b for a, b in links)


def test_unlike_sets_share_no_empty_signature():
    """Sets without a common shingle: what a signature keeps is hardly ever nothing."""
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 1 << 63, (2000, 90), dtype=np.uint64) * np.uint64(2), axis=1).ravel()
    sig, whose = partenum.signatures(values, np.arange(2001) * 90, 80)
    _, group, many = np.unique(sig, return_inverse=True, return_counts=True)
    assert many.max() <= 20 and np.isin(np.arange(2000), whose).all()


def test_similar_sets_share_a_signature_at_every_distance():
    """Every pair within the limit, however its differences fall, keeps a signature in common."""
    rng = np.random.default_rng(4)
    for percent in (50, 80, 85, 95):
        for n in (2, 4, 5, 7, 12, 30, 90, 400):
            for _ in range(40):
                one = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
                gone = rng.integers(0, n)
                two = np.concatenate((one[gone:], rng.integers(0, 1 << 63, rng.integers(0, n), dtype=np.uint64) * np.uint64(2)))
                both = n - gone
                if 100 * both < percent * (n + len(two) - both) or len(two) == n == both:
                    continue
                sets = [np.sort(one), np.sort(two)]
                sig, whose = partenum.signatures(np.concatenate(sets), np.array([0, n, n + len(two)]), percent)
                assert np.intersect1d(sig[whose == 0], sig[whose == 1]).size, (percent, n, gone, len(two))


def test_cells_leave_out_what_the_center_has_met(spark, monkeypatch):
    """A group of two has nothing left to compare, and only sets that short sketches leave bring whole ones."""
    texts = [" ".join(f"w{i}-{j}" for j in range(40)) + " " + " ".join(f"p{j}" for j in range(40)) for i in range(2)]
    seen = []
    real = partenum.SetJoin.open_members
    monkeypatch.setattr(partenum.SetJoin, "open_members", lambda self, cells: (seen.append(cells.count()), real(self, cells))[1])
    got = partenum.jaccard_components(frame(spark, texts), 5, 80).collect()
    assert seen == [0] and sorted(r.component_id for r in got) == [0, 1]


@pytest.mark.parametrize("together", [0, 128])
def test_cells_of_a_center_are_dealt_together(spark, monkeypatch, together):
    """Small cells of one center go to one task, larger ones each to its own; what they unite is the same."""
    texts = [" ".join(f"w{i % 5}-{j}" if j % 40 < 8 else f"p{j}" for j in range(200)) + f" t{i}" for i in range(20)]
    seen = []
    real = partenum.SetJoin.open_members
    monkeypatch.setattr(partenum, "TOGETHER", together)
    monkeypatch.setattr(partenum.SetJoin, "open_members", lambda self, cells: (seen.extend(cells.collect()), real(self, cells))[1])
    docs = frame(spark, texts)
    got = {r.doc_id: r.component_id for r in partenum.jaccard_components(docs, 5, 80).collect()}
    assert got == {d: c for d, _, c in brute(list(enumerate(texts)), 5, 80)}
    cells = {r.cell: r.deal for r in seen}
    assert len(cells) > 1 and len({(r.cell, r.deal) for r in seen}) == len(cells)
    assert all(c == d for c, d in cells.items()) if together == 0 else len(set(cells.values())) < len(cells)


def test_short_sketches_never_exclude_more(spark):
    rng = np.random.default_rng(5)
    a = np.sort(rng.integers(0, 1 << 62, 300, dtype=np.uint64))
    for gone in (0, 5, 20, 33, 60):
        b = np.sort(np.concatenate((a[gone:], rng.integers(0, 1 << 62, gone, dtype=np.uint64))))
        own = partenum.sketches(np.concatenate((a, b)), np.array([0, 300, 600]), 80)
        short = [partenum.short_sketch(x) for x in own]
        assert 4 * len(short[0]) == len(own[0])
        assert partenum.possible([300], short[:1], [300], short[1:], 80)[0] >= partenum.possible([300], own[:1], [300], own[1:], 80)[0]
