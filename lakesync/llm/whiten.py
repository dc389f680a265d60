"""Embedding whitening by incremental eigendecomposition.

A task keeps the count, mean and spectrum of the vectors that it has seen.  A
vector enters as a centred rank-one update: the eigenvalues are the roots of a
secular equation, the eigenvectors follow from them, and directions that the
update leaves alone are deflated.  Two spectra are combined in the same way: the
eigenpairs of one, and the shift between the means, are successive rank-one
updates of the other.  Spectra meet in groups of eight, round by round.  The last
basis is refined by one distributed Rayleigh-Ritz step over all centred vectors.

The vectors hold integers; sums and deviations are exact.  A task holds one
spectrum (dimension squared); only a matrix of that size and one row of sums come
to the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import grouped_rows, stored
from lakesync.llm.vectors import matrix_of, packed, rows_of, usable, widest

GATHER = 8  # partial results combined in one task of a round
_TINY = 8 * np.finfo(float).eps


def secular(values: np.ndarray, z: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z**2 / (values - root)) = 0``, for ascending distinct ``values`` and no zero in ``z``.

    Root i lies above value i and below the next one.  Also the distances
    ``values[j] - root[i]`` at [j, i]: a root is sought as its distance from the
    nearer end of its interval, so that they keep their relative precision.  A
    step solves for the pole at that end, with the other terms linear, and
    halves the bracket where it would leave it."""
    z2 = z * z
    half = 0.5 * np.append(np.diff(values), z2.sum())
    gap = values[:, None] - values[None, :]
    above = 1.0 + (z2[:, None] / (gap - half)).sum(axis=0) < 0  # the root lies in the upper half
    right = above.copy()
    right[-1] = False
    origin = np.arange(len(values)) + right
    seen, pole = values[:, None] - values[origin], z2[origin]
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    if above[-1]:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    tau = 0.5 * (low + high)
    others = np.where(np.arange(len(values))[:, None] == origin, 0.0, z2[:, None])
    for _ in range(steps):
        apart = seen - tau
        term = others / apart
        rest, slope = 1.0 + term.sum(axis=0), (term / apart).sum(axis=0)
        below = (rest * tau < pole) != right  # the function is negative: the root lies above
        low, high = np.where(below, tau, low), np.where(below, high, tau)
        c = rest - slope * tau
        with np.errstate(all="ignore"):
            # the roots of slope * t**2 + c * t - pole, each without cancellation
            far = np.abs(c) + np.sqrt(c * c + 4 * slope * pole)
            new = np.where(right == (c >= 0), np.where(right, -far, far) / (2 * slope), np.where(right, -2 * pole, 2 * pole) / far)
        slack = 1e-12 * np.abs(tau)  # a step that rounding takes out of the bracket ends on its border
        bad = ~((new >= low - slack) & (new <= high + slack))
        new = np.clip(np.where(bad, 0.5 * (low + high), new), low, high)
        done = np.all(np.abs(new - tau) <= 1e-9 * np.abs(new))
        tau = new
        if done:
            break
    return values[origin] + tau, seen - tau


class Spectrum:
    """Count, mean and eigenpairs (ascending) of the scatter matrix of the vectors added so far."""

    def __init__(self, dim: int):
        self.count, self.mean = 0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def update(self, vector: np.ndarray) -> None:
        """The eigenpairs of the scatter matrix plus the square of ``vector``."""
        z = vector @ self.vectors
        size = float(np.sqrt(z @ z))
        if size == 0:
            return
        tiny = _TINY * max(self.values[-1], size * size)
        # equal eigenvalues: one of their directions takes all of the vector
        starts = np.flatnonzero(np.append(True, np.diff(self.values) > tiny))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(z)]):
            if b - a > 1 and (length := float(np.sqrt(z[a:b] @ z[a:b]))) > 0:
                mirror = z[a:b].copy()
                mirror[0] += length if mirror[0] >= 0 else -length
                mirror /= np.sqrt(mirror @ mirror)
                self.vectors[:, a:b] -= 2 * np.outer(self.vectors[:, a:b] @ mirror, mirror)
                z[a:b] = 0
                z[a] = length
                self.vectors[:, a] *= -1 if self.vectors[:, a] @ vector < 0 else 1
        live = np.abs(z) * size > tiny
        values, own = self.values[live], np.abs(z[live])
        if not len(values):
            return
        # the signs of z go into the vectors
        basis = self.vectors[:, live] * np.sign(z[live])
        roots, apart = secular(values, own)
        # the vector for which these roots are exact: keeps the new eigenvectors orthogonal
        other = values[None, :] - values[:, None]
        np.fill_diagonal(other, 1.0)
        exact = np.sqrt(np.abs(np.prod(-apart / other, axis=1)))
        turn = exact[:, None] / apart
        turn /= np.sqrt((turn * turn).sum(axis=0))
        self.vectors[:, live] = basis @ turn
        self.values[live] = roots
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def add(self, vector: np.ndarray) -> None:
        """One more vector: a centred rank-one update."""
        self.count += 1
        off = vector - self.mean
        self.mean = self.mean + off / self.count
        self.update(off * np.sqrt((self.count - 1) / self.count))

    def join(self, other: Spectrum) -> None:
        """The vectors of another spectrum: its eigenpairs and the shift of the means as rank-one updates."""
        if not other.count:
            return
        total = self.count + other.count
        off = other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector * np.sqrt(value))
        if self.count:
            self.update(off * np.sqrt(self.count / total * other.count))
        self.mean = self.mean + off * (other.count / total)
        self.count = total

    def numbers(self) -> np.ndarray:
        return np.concatenate(([float(self.count)], self.mean, self.values, self.vectors.ravel()))

    @classmethod
    def of(cls, numbers: np.ndarray, dim: int) -> Spectrum:
        out = cls(dim)
        out.count, out.mean, out.values = int(numbers[0]), numbers[1:dim + 1], numbers[dim + 1:2 * dim + 1].copy()
        out.vectors = numbers[2 * dim + 1:].reshape(dim, dim).copy()
        return out


_PART = "place long, body binary"


def _parts(rows: DataFrame, reduce) -> DataFrame:
    """``reduce(matrices)`` of each task: an array of doubles, under the task's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = reduce(b.column("v").to_pylist() for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["place", "body"])

    return rows.mapInArrow(run, _PART)


def _gathered(parts: DataFrame, merge) -> np.ndarray | None:
    """All partial results merged, eight in a task and round by round; the last one comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_rows(batches, "up"):
            out = None
            for body in group.column("body").to_pylist():
                out = merge(out, np.frombuffer(body))
            yield pa.RecordBatch.from_arrays([pa.array([group.column("up")[0].as_py()], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["place", "body"])

    parts = stored(parts, "parts")
    while (last := parts.agg(F.max("place")).first()[0]):
        met = parts.withColumn("up", F.floor(F.col("place") / GATHER)).repartition(max(1, -(-last // GATHER)), "up").sortWithinPartitions("up", "place")
        parts = stored(met.mapInArrow(run, _PART), "parts")
    row = parts.first()
    return None if row is None else np.frombuffer(row.body).copy()


def _summed(out: np.ndarray | None, more: np.ndarray) -> np.ndarray:
    return more if out is None else out + more


def _sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += matrix_of(batch.column("v"), dim).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim), pa.int32()), pa.array(np.append(n, total), pa.int64())], ["place", "s"])

    got = rows.mapInArrow(run, "place int, s long").groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("place").collect()
    return (int(got[0].s), [int(r.s) for r in got[1:]]) if got else (0, [])


_OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", basis: int | None = None) -> DataFrame:
    """A row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``vectors`` hold integers.  The components are the unit eigenvectors of the
    covariance (divisor n) by falling eigenvalue.  ``whitened`` is the centred
    vector on the component over the root of its eigenvalue, ``explained`` the
    eigenvalue's share of the trace, ``deviation`` the exact sum of
    (n * x - sum)^2 (null beyond a long), and ``identity_error`` the largest
    entry of the whitened covariance minus the identity.  ``basis``: how many
    leading directions the last refinement works on, by default all up to four
    times the components.

    Vectors that are null, empty or hold a null or non-finite entry are left out;
    shorter ones are filled with zeros.  Components without variance (constant
    columns, fewer vectors than columns) are left out, so a table of one vector,
    of equal ones or of none has no rows.  Repeated rows count as often as they
    occur; each keeps its rows.  Other columns are ignored, whatever their names."""
    own = vectors.where(usable(F.col(vec_col)))
    dim = widest(own, vec_col)
    empty = own.sparkSession.createDataFrame([], _OUT_DDL)
    if not dim:
        return empty
    rows = stored(packed(own, id_col, vec_col, dim), "vectors")
    n, sums = _sums(rows, dim)
    # vectors are centred on integers first; what is left of the mean is less than one half
    near = [(2 * s + n) // (2 * n) for s in sums]
    centre, rest = np.array(near, float), np.array([(s - n * c) / n for s, c in zip(sums, near)])

    def centred(raw: list[bytes]) -> np.ndarray:
        return matrix_of(raw, dim) - centre - rest

    def spectrum(batches) -> np.ndarray:
        out = Spectrum(dim)
        for raw in batches:
            for row in centred(raw):
                out.add(row)
        return out.numbers()

    def combined(out: np.ndarray | None, more: np.ndarray) -> np.ndarray:
        if out is None:
            return more
        one, two = sorted((Spectrum.of(out, dim), Spectrum.of(more, dim)), key=lambda s: -s.count)
        one.join(two)
        return one.numbers()

    found = Spectrum.of(_gathered(_parts(rows, spectrum), combined), dim)
    width = min(dim, basis or 4 * components)
    start, _ = np.linalg.qr(found.vectors[:, ::-1][:, :width])

    def projected(batches) -> np.ndarray:
        out, trace = np.zeros((width, width)), 0.0
        for raw in batches:
            rows = centred(raw)
            on = rows @ start
            out += on.T @ on
            trace += float((rows * rows).sum())
        return np.append(out.ravel(), trace)

    ritz = _gathered(_parts(rows, projected), _summed) / n
    trace, ritz = ritz[-1], ritz[:-1].reshape(width, width)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    some = values > 1e-13 * dim * max(trace, 0)
    if not some.any():
        return empty
    values, axes = values[some], start @ turn[:, some]
    scaled, count = axes / np.sqrt(values), int(some.sum())

    def moments(batches) -> np.ndarray:
        out, total = np.zeros((count, count)), np.zeros(count)
        for raw in batches:
            on = centred(raw) @ scaled
            out += on.T @ on
            total += on.sum(axis=0)
        return np.append(out.ravel(), total)

    got = _gathered(_parts(rows, moments), _summed) / n
    mean = got[count * count:]
    error = float(np.abs(got[:count * count].reshape(count, count) - np.outer(mean, mean) - np.eye(count)).max())
    explained, names = values / trace, empty.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column("v").to_pylist()
                m = len(raw)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(part.column("id").to_numpy(zero_copy_only=False), count)) if not part.column("id").null_count
                    else pa.array([i for i in part.column("id").to_pylist() for _ in range(count)], pa.int64()),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n, np.int64)),
                    pa.array([d for d in deviations(matrix_of(raw, dim), n, sums) for _ in range(count)], pa.int64()),
                    pa.array((centred(raw) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error))], names)

    return rows.mapInArrow(run, _OUT_DDL)


def deviations(matrix: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over the columns of (n * x - sum)^2, exactly; None beyond a long."""
    off = [[n * x - s for x, s in zip(row, sums)] for row in matrix.astype(np.int64).tolist()] if n * (np.abs(matrix).max(initial=0) + 1) >= 2 ** 62 else (
        n * matrix.astype(np.int64) - np.array(sums, np.int64))
    if isinstance(off, np.ndarray) and int(np.abs(off).max(initial=0)) ** 2 * matrix.shape[1] < 2 ** 63:
        return (off * off).sum(axis=1).tolist()
    exact = (sum(int(x) ** 2 for x in row) for row in off)
    return [e if e < 2 ** 63 else None for e in exact]


__all__ = ["secular", "Spectrum", "whiten", "deviations"]
