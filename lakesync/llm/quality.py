"""Quality: a linear-chain CRF over the lines of a document (operator 10).

Every line is good or bad.  A line's evidence is what it is made of (letters,
capitals, digits, symbols, word lengths, repeats) and what its neighbouring
lines are made of; transitions tie the labels of neighbours.  Forward-backward
gives the marginal of each line; their mean, weighted by line length, is the
document's quality, calibrated to a probability on the training documents.

Training runs in numpy on the driver on at most ``train_docs`` labelled
documents of each class (a documented bound; their line features come from
Spark); lines take the label of their document.  Scoring runs over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import byte_slices, id_text, text_bytes, with_scores
from lakesync.llm.textops import mix, word_hashes

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c",
          "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+<=>@[\\]^_`{}~/", "high": bytes(range(128, 256))}
_BYTE = np.zeros((256, len(_KINDS)), np.float32)
for _i, _chars in enumerate(_KINDS.values()):
    _BYTE[list(_chars), _i] = 1

OWN = len(_KINDS) + 8
WIDTH = 3 * OWN + 2


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) of all lines, their bytes, and the n + 1 line bounds of the texts.

    An empty text has one empty line."""
    data, bounds = text_bytes(text)
    n = len(bounds) - 1
    # a line break after each text, so that every text ends a line
    owner = np.repeat(np.arange(n), np.diff(bounds))
    flat = np.full(len(data) + n, 0x0A, np.uint8)
    flat[np.arange(len(data)) + owner] = data
    ends = np.flatnonzero(flat == 0x0A)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float64)
    last = bounds[1:] + np.arange(n)
    of = np.searchsorted(ends, last) + 1
    lines = np.concatenate(([0], of))
    row = np.repeat(np.arange(n), np.diff(lines))
    share = np.stack([np.add.reduceat(_BYTE[flat, k], starts) for k in range(len(_KINDS))], 1) / np.maximum(size, 1)[:, None]
    words, at = word_hashes(flat, np.concatenate((starts, [len(flat)])))
    count = np.diff(at).astype(np.float64)
    line = np.repeat(np.arange(len(starts)), np.diff(at))
    key = mix(words + mix(line.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order][1:] == key[order][:-1]
    repeats = np.bincount(line, again, len(starts)) / np.maximum(count, 1)
    echo = np.zeros(len(words))
    if len(words) > 1:
        echo[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    echoes = np.bincount(line, echo, len(starts)) / np.maximum(count, 1)
    # lines that occur again in their document
    whole = np.bincount(line, (mix(words + (np.arange(len(words)) - at[:-1][line]).astype(np.uint64)) >> np.uint64(20)).astype(np.float64), len(starts))
    same = np.unique(np.stack([row.astype(np.float64), whole], 1), axis=0, return_inverse=True, return_counts=True)
    copied = (same[2][same[1].ravel()] > 1) & (size > 0)
    longest = np.log1p(size / np.maximum(count, 1))
    own = np.concatenate((share, np.stack([np.log1p(size) / 5, np.log1p(count) / 5, longest, repeats, echoes, copied, count <= 3,
                                           np.log1p(np.diff(lines))[row] / 5], 1)), 1)
    first, final = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    first[lines[:-1]], final[lines[1:] - 1] = True, True
    before = np.concatenate((np.zeros((1, OWN)), own[:-1])) * ~first[:, None]
    after = np.concatenate((own[1:], np.zeros((1, OWN)))) * ~final[:, None]
    return np.concatenate((own, before, after, first[:, None], final[:, None]), 1).astype(np.float32), size, lines


def forward_backward(good: np.ndarray, lines: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log messages of all chains at once: forward, backward (lines x 2), log of the sum over labellings, P(good) of each line.

    ``good``: each line's score of the label good (bad has 0); ``pair``: 2 x 2
    transition scores.  Chains advance together, the longest first."""
    own = np.stack([np.zeros_like(good), good], 1)
    n = np.diff(lines)
    order = np.argsort(-n, kind="stable")
    start, n = lines[:-1][order], n[order]
    fwd, bwd = own.copy(), np.zeros_like(own)
    alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")  # chains with more than t lines
    for t in range(1, len(alive)):
        at = start[:alive[t]] + t
        prev = fwd[at - 1]
        fwd[at] += np.logaddexp(prev[:, :1] + pair[0], prev[:, 1:] + pair[1])
    for t in range(len(alive) - 1, 0, -1):
        at = start[:alive[t]] + t
        then = own[at] + bwd[at]
        bwd[at - 1] = np.logaddexp(then[:, :1] + pair[:, 0], then[:, 1:] + pair[:, 1])
    total = np.logaddexp(*fwd[lines[1:] - 1].T) if len(n) else np.zeros(0)
    return fwd, bwd, total, np.exp(fwd[:, 1] + bwd[:, 1] - np.repeat(total, np.diff(lines)))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    bias: float
    pair: np.ndarray
    slope: float
    shift: float

    def lines(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        return forward_backward((features - self.mean) / self.spread @ self.weight + self.bias, lines, self.pair)[3]

    def quality(self, features, size, lines) -> np.ndarray:
        """The length-weighted mean marginal of each text, as log odds."""
        weight = size + 1
        p = np.add.reduceat(self.lines(features, lines) * weight, lines[:-1]) / np.add.reduceat(weight, lines[:-1])
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def scores(self, text: pa.Array) -> np.ndarray:
        if len(text) == 0:
            return np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * self.quality(*line_features(text)) + self.shift)))


def fit(features: np.ndarray, size: np.ndarray, lines: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 150, rate: float = 0.1) -> Model:
    """Penalised conditional likelihood by Adam over whole chains; then one logistic fit for the calibration.

    Each document's chain counts ``weights`` over its number of lines, so a long document outweighs no other."""
    mean, spread = features.mean(0), features.std(0) + 1e-3
    x = (features - mean) / spread
    n = np.diff(lines)
    row = np.repeat(np.arange(len(n)), n)
    y = labels[row].astype(float)
    share = (weights / n / weights.sum())[row]
    inner = np.ones(len(x), bool)
    inner[lines[1:] - 1] = False
    inner = np.flatnonzero(inner)  # lines with a next line in their text
    theta = np.zeros(x.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (share[inner] * (y[inner] == label)).sum()
    for step in range(1, steps + 1):
        weight, bias, pair = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        good = x @ weight + bias
        fwd, bwd, total, p = forward_backward(good, lines, pair)
        own = np.stack([np.zeros_like(good), good], 1)
        z = total[row[inner]]
        expected = np.array([[(share[inner] * np.exp(fwd[inner, i] + pair[i, j] + own[inner + 1, j] + bwd[inner + 1, j] - z)).sum() for j in (0, 1)] for i in (0, 1)])
        back = share * (y - p)
        grad = np.concatenate((x.T @ back - 1e-4 * weight, [back.sum()], (seen - expected).ravel() - 1e-3 * pair.ravel()))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta += rate * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    model = Model(mean, spread, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2), 1.0, 0.0)
    q = model.quality(features, size, lines)
    a = np.array([1.0, 0.0])
    basis = np.stack([q, np.ones_like(q)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(basis @ a, -40, 40)))
        curve = (basis * (weights * p * (1 - p))[:, None]).T @ basis + 1e-3 * weights.mean() * np.eye(2)
        a = a + np.clip(np.linalg.solve(curve, basis.T @ (weights * (labels - p)) - 1e-3 * weights.mean() * a), -1, 1)
    model.slope, model.shift = map(float, a)
    return model


_LINES = pa.schema([("label", pa.int32()), ("lines", pa.int32()), ("features", pa.binary()), ("size", pa.binary())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in byte_slices(batch, "text", 1 << 20):
            x, size, lines = line_features(own.column("text"))
            cut = list(zip(lines, lines[1:]))
            yield pa.RecordBatch.from_arrays([own.column("label"), pa.array(np.diff(lines), pa.int32()),
                                              pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()),
                                              pa.array([size[a:b].tobytes() for a, b in cut], pa.binary())], schema=_LINES)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: Column | None = None, train_docs: int = 2000,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``train_docs`` labelled texts of each class, the first by a hash of the id.

    ``rows``: which labelled rows may be used (a condition on ``doc_id``).  Null
    labels and ids take no part; without labels of both classes every text scores
    the share of class 1 (1 without any labels: nothing is rejected unlearned)."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(rows) if rows is not None else known
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    own = id_text(docs, id_col, text_col)
    known = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    share = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        one = 20.0 if share.get(1) or not share else -20.0
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, np.zeros((2, 2)), 0.0, one)
    picked = None
    for k in (0, 1):  # a bounded top-k by hash in each class
        part = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        picked = part if picked is None else picked.unionByName(part)
    # the picked ids are bounded, so they go to the texts and no text is shuffled
    got = own.join(F.broadcast(picked), "doc_id").select("label", "text").mapInArrow(_features, "label int, lines int, features binary, size binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.features)))
    y = np.array([r.label for r in got])
    weights = (np.array([share[k] / (y == k).sum() for k in (0, 1)]) ** 0.75)[y]
    x = np.concatenate([np.frombuffer(r.features, np.float32).reshape(r.lines, WIDTH) for r in got])
    size = np.concatenate([np.frombuffer(r.size, np.float64) for r in got])
    return fit(x, size, np.concatenate(([0], np.cumsum([r.lines for r in got]))), y, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, then the columns ``keep`` as they were; a null or empty text is one empty line."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kB
    return with_scores(docs, lambda text: sent.value.scores(text), keep, id_col, text_col)


__all__ = ["WIDTH", "Model", "line_features", "forward_backward", "fit", "train", "score"]
