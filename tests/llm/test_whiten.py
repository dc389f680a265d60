"""Whitening against an eigendecomposition of the exact covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesync.llm import whiten as W
from lakesync.llm.queries import op11_whitening


def test_secular():
    rng = np.random.default_rng(4)
    for m, scale in ((1, 1.0), (2, 1.0), (30, 1e-9), (30, 1.0), (30, 1e9)):
        values, z = np.sort(rng.uniform(0, 5, m)) ** 4, rng.uniform(1e-3, 1, m) * scale
        roots, apart = W.secular(values, z)
        want = np.linalg.eigvalsh(np.diag(values) + np.outer(z, z))
        assert np.allclose(roots, want, rtol=1e-12, atol=1e-12 * max(want[-1], 1))
        assert (apart.diagonal() < 0).all() and (roots > values).all() or scale < 1e-6


def kinds():
    rng = np.random.default_rng(7)
    yield "full", rng.normal(size=(300, 12)) * rng.uniform(0.01, 100, 12)
    yield "far from zero", rng.integers(0, 40, (200, 9)) + 1e6
    yield "few", rng.normal(size=(4, 10))
    yield "repeated", np.repeat(rng.integers(-9, 9, (6, 8)), 30, axis=0).astype(float)
    yield "constant columns", np.hstack((np.full((50, 3), 7.0), rng.normal(size=(50, 3))))
    yield "equal spread", np.vstack((np.eye(6), -np.eye(6)))
    yield "one column", rng.normal(size=(20, 1))


@pytest.mark.parametrize("name,rows", list(kinds()))
def test_spectra(name, rows):
    """Row by row, and two halves joined, give the scatter matrix."""
    dim = rows.shape[1]
    off = rows - rows.mean(axis=0)
    want = off.T @ off
    whole, one, two = W.Spectrum(dim), W.Spectrum(dim), W.Spectrum(dim)
    for i, r in enumerate(rows):
        whole.add(r)
        (one if i % 3 else two).add(r)
    one.join(two)
    one.join(W.Spectrum(dim))
    for s in (whole, W.Spectrum.of(one.numbers(), dim)):
        assert s.count == len(rows) and np.allclose(s.mean, rows.mean(axis=0))
        assert np.allclose(s.vectors * s.values @ s.vectors.T, want, atol=1e-9 * max(1, np.abs(want).max()))
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(dim), atol=1e-10)


def exact(rows, k):
    """n, deviations, eigenvalues, axes and trace by integers and one eigh."""
    n, d = len(rows), len(rows[0])
    sums = [sum(r[j] for r in rows) for j in range(d)]
    off = [[n * x - s for x, s in zip(r, sums)] for r in rows]
    cov = np.array([[sum(o[i] * o[j] for o in off) / n ** 3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    return n, [sum(x * x for x in o) for o in off], values[::-1][:k], axes[:, ::-1][:, :k], np.trace(cov), np.array(off, float) / n


def test_equals_exact(spark, tmp_path):
    rng = np.random.default_rng(5)
    vecs = (rng.normal(size=(400, 20)) * np.linspace(0.2, 3, 20)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vecs)] + [(7, vecs[7]), (900, None), (901, [None] + vecs[0][1:]), (902, [float("nan")] + vecs[0][1:]),
                                                   (903, [float("inf")] * 20), (904, [0.0] * 20), (905, vecs[3]), (None, vecs[9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("extra") for c in ("n", "id", "v", "place", "body")})
    df.repartition(11).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_whitening(spark, str(tmp_path)).toPandas()
    kept = [(i, [math.floor(64 * float(c)) + 1000000 for c in np.float32(v)]) for i, v in rows if i is None or i < 900 or i > 903]
    n, dev, values, axes, trace, off = exact([v for _, v in kept], 32)
    assert len(got) == len(kept) * 20 and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    want = off @ axes / np.sqrt(values)
    for (i, _), d, w in zip(kept, dev, want):
        own = got[got.vec_id.isna()] if i is None else got[got.vec_id == i]
        own = own.sort_values("component").drop_duplicates("component")
        assert set(own.deviation) == {d} and np.allclose(np.abs(own.whitened), np.abs(w), atol=1e-7)
    shares = got.groupby("component").explained.first()
    assert np.allclose(shares, values / trace, rtol=1e-10)
    signs = [np.sign(got[(got.vec_id == 5) & (got.component == c)].whitened.iloc[0] * want[5, c - 1]) for c in range(1, 21)]
    for c in range(1, 21):
        own = got[(got.component == c) & (got.vec_id < 400)].drop_duplicates("vec_id").sort_values("vec_id")
        assert np.allclose(own.whitened * signs[c - 1], want[:400, c - 1], atol=1e-7)


def test_subspace(spark):
    """More columns than the refinement works on: the leading components still whiten."""
    rng = np.random.default_rng(6)
    rows = np.floor(rng.normal(size=(500, 24)) * 2.0 ** np.arange(12, 0, -0.5)).astype(int)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<long>")
    got = W.whiten(df, 4, basis=8).toPandas()
    _, _, values, _, trace, _ = exact(rows.tolist(), 4)
    assert np.allclose(got.groupby("component").explained.first(), values / trace, rtol=1e-6) and got.identity_error.max() < 1e-9


def test_degenerate(spark):
    def rows(data):
        return W.whiten(spark.createDataFrame(data, "vec_id long, embedding array<long>")).collect()

    assert rows([]) == [] and rows([(1, [1, 2])]) == [] and rows([(1, [1, 2]), (2, [1, 2])]) == [] and rows([(1, None), (2, [])]) == []
    got = rows([(1, [0, 5]), (2, [2]), (3, [4, 5])])  # a short vector is filled with zeros
    assert {r.component for r in got} == {1, 2} and got[0].n == 3


def test_deviations_beyond_a_long():
    matrix = np.array([[10.0 ** 12, 0.0], [0.0, 1.0]])
    assert W.deviations(matrix, 2, [10 ** 12, 1]) == [None, None]
    assert W.deviations(matrix[:, 1:], 2, [1]) == [1, 1]
    assert W.deviations(np.array([[3.0 * 10 ** 9], [0.0]]), 1, [0]) == [9 * 10 ** 18, 0]
