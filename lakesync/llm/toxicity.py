"""Toxicity: subword-bag embeddings averaged into a linear softmax (operator 9).

Every character n-gram of a word (with its borders) and every whole word is a
hashed subword with an embedding.  A text is the average of its subwords'
embeddings; embeddings and softmax weights are trained together.  A misspelling
shares most n-grams with the word it comes from.

Training runs in numpy in one task, on at most ``train_docs`` labelled texts
of each class (a documented bound; their subword counts come from Spark), and
the driver gets the model alone.
Scoring runs over all texts: the classes are linear in the average, so each
subword contributes one number, and the model is one small array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import byte_slices, id_text, text_bytes, with_scores
from lakesync.llm.textops import gram_hashes, mix

BUCKETS = 1 << 18
GRAMS = (3, 4, 5, 6)
# so many subwords of no weight are averaged into each text: a few chance n-grams decide no short text
NEUTRAL = 800
# bytes of text whose subwords are held at a time (some 120 bytes of memory each)
PIECE = 1 << 18
# the average is over thousands of subwords of which few tell: scaled up so that steps reach them
SCALE = 100.0
# parts of the training texts that are scored by models of the others, to calibrate
FOLDS = 3
# of the clean training texts, those that calibration lets a model of the others call toxic
FALSE_ALARMS = 0.03
# an empty text's logit is at most this: nothing in it is toxic
EMPTY = -0.5

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[0x41:0x5B] += 0x20
_CLEAN[[b for b in range(0x80) if not chr(b).isalnum()]] = 0x20


def subwords(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Subword buckets of all texts (in one array) and the row each belongs to."""
    data, bounds = text_bytes(text)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    spaced = np.full(len(data) + len(bounds), 0x20, np.uint8)  # a space before each text and at the end
    spaced[np.arange(len(data)) + owner + 1] = _CLEAN[data]
    row = np.full(len(spaced), -1, np.int64)
    row[np.arange(len(data)) + owner + 1] = owner
    solid = spaced != 0x20
    buckets, rows = [], []
    gaps = np.concatenate(([0], np.cumsum(~solid)))
    for n in GRAMS:
        h = gram_hashes(spaced, n)
        if len(h) == 0:
            continue
        # no space inside, at most at the two ends
        k = np.flatnonzero(gaps[n - 1:len(h) + n - 1] == gaps[1:len(h) + 1])
        buckets.append((mix(h[k] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
        rows.append(row[k + 1])
    # whole words: the sum of their bytes' place-weighted hashes, by the pairs of the word
    begin = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    if len(begin):
        two = gram_hashes(np.concatenate((spaced, np.full(1, 0x20, np.uint8))), 2)  # the last pair is a byte and the space
        place = np.arange(len(spaced)) - begin[np.maximum(np.searchsorted(begin, np.arange(len(spaced)), side="right") - 1, 0)]
        chain = np.where(solid, mix(two + (np.maximum(place, 0).astype(np.uint64) << np.uint64(8))), np.uint64(0))
        buckets.append((mix(np.add.reduceat(chain, begin)) % np.uint64(BUCKETS)).astype(np.int32))
        rows.append(row[begin])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


def pieces(text: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The texts in parts of about ``PIECE`` bytes: the row of each part's texts, and these.

    A longer text is cut before a byte that is in no word, so its subwords are
    those of its parts; only a single word is never cut."""
    data, bounds = text_bytes(text)
    starts, rows = [], []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        starts.append(a)
        rows.append(i)
        while b - a > PIECE:
            gap, at = np.zeros(0, np.int64), a + PIECE
            while not len(gap) and at < b:
                gap, at = np.flatnonzero(_CLEAN[data[at:min(at + PIECE, b)]] == 0x20) + at, at + PIECE
            if not len(gap):
                break
            a = int(gap[0])
            starts.append(a)
            rows.append(i)
    cuts, rows = np.array([*starts, len(data)]), np.array(rows, np.int64)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PIECE, side="right")) - 1)
        own = data[cuts[at]:cuts[stop]]
        yield rows[at:stop], pa.Array.from_buffers(pa.large_binary(), stop - at, [None, pa.py_buffer((cuts[at:stop + 1] - cuts[at]).astype(np.int64).tobytes()), pa.py_buffer(own.tobytes())])
        at = stop


def counted(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row * BUCKETS + bucket, ascending, and how often) of all texts."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for own, part in pieces(text):
        buckets, rows = subwords(part)
        key, n = np.unique(own[rows] * BUCKETS + buckets, return_counts=True)
        both, where = np.unique(np.concatenate((keys, key)), return_inverse=True)
        keys, counts = both, np.bincount(where, np.concatenate((counts, n)), len(both)).astype(np.int64)
    return keys, counts


@dataclass
class Model:
    """``weight`` of each bucket towards class 1, ``bias``; a text's logit is bias + mean weight."""

    weight: np.ndarray
    bias: float

    def scores(self, text: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(text)), np.zeros(len(text))
        for own, part in pieces(text):
            buckets, rows = subwords(part)
            first = own[0]  # rows ascend
            total[first:own[-1] + 1] += np.bincount(own[rows] - first, self.weight[buckets], minlength=own[-1] - first + 1)
            count[first:own[-1] + 1] += np.bincount(own[rows] - first, minlength=own[-1] - first + 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / (count + NEUTRAL), -50, 50)))


def _segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, dim: int = 4, epochs: int = 6,
        batch: int = 64, rate: float = 20.0, least_steps: int = 200, min_texts: int = 3, damping: float = 1e-3, seed: int = 7) -> Model:
    """Train embeddings (buckets x ``dim``) and softmax weights together by Adagrad.

    ``texts``: (distinct buckets, counts) of each text; ``weights``: what each
    text counts in the loss.  ``damping`` is what Adagrad takes as seen of each
    bucket before the first step: a bucket moves by its evidence, so rare ones
    learn little by heart whatever the number of texts.  Buckets of fewer than
    ``min_texts`` texts stay at zero."""
    rng = np.random.default_rng(seed)
    total = np.array([c.sum() for _, c in texts], float)
    held = np.zeros(BUCKETS, np.int32)
    for b, _ in texts:
        held[b] += 1
    often = held >= min_texts
    for i, (b, c) in enumerate(texts):  # in place: the driver holds one copy
        texts[i] = b[often[b]], c[often[b]]
    table = rng.normal(0, 0.01, (BUCKETS, dim)) * often[:, None]
    soft = rng.normal(0, 0.5, (dim, 2))
    bias = np.zeros(2)
    table_sq, soft_sq = np.full(BUCKETS, damping), np.full((dim, 2), 1e-8)
    # the average is over ~10^4 subwords of which few tell: scaled up so that steps reach them
    scale = SCALE
    batches = max(1, -(-len(texts) // batch))
    rounds, step_no = max(epochs, -(-least_steps // batches)), 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            now = 0.1 * rate * (1 - step_no / (rounds * batches))  # falls to nothing, so the end is settled
            step_no += 1
            ids = np.concatenate([texts[i][0] for i in own])
            size = np.array([len(texts[i][0]) for i in own])
            share = np.concatenate([texts[i][1] / (total[i] + NEUTRAL) for i in own]) * scale
            bounds = np.concatenate(([0], np.cumsum(size)))
            hidden = _segment_sum(table[ids] * share[:, None], bounds)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= weights[own][:, None] / len(own)
            back = p @ soft.T
            grad = back.repeat(size, 0) * share[:, None]
            touched, where = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(where, grad[:, k], len(touched)) for k in range(dim)], 1)
            table_sq[touched] += (step ** 2).mean(1)
            table[touched] -= now * step / np.sqrt(table_sq[touched])[:, None]
            g = hidden.T @ p
            soft_sq += g ** 2
            soft -= now * g / np.sqrt(soft_sq)
            bias -= now * p.sum(0)
    return Model((table @ (soft[:, 1] - soft[:, 0]) * scale).astype(np.float32), float(bias[1] - bias[0]))


def calibrated(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> Model:
    """``fit``, with a number added to all weights that balances the errors on training texts the model did not see.

    Each of ``FOLDS`` parts is scored by a model of the others.  The number is the
    middle of those with the best balanced accuracy among those that call at most
    ``FALSE_ALARMS`` of the clean texts toxic.  Like all weights it counts by a
    text's length, so it hardly moves short texts and leaves empty ones.

    The bias, which decides these, is then lowered to ``EMPTY`` or further, until
    at most ``FALSE_ALARMS`` of the clean texts of fewer than ``NEUTRAL`` subwords
    are called toxic; the weights rise by as much, so long texts stay as they are."""
    fold = np.zeros(len(labels), np.int64)
    for k in (0, 1):
        fold[labels == k] = np.arange((labels == k).sum()) % FOLDS
    logit, share = np.zeros(len(labels)), np.zeros(len(labels))
    for f in range(FOLDS):
        own = np.flatnonzero(fold != f)
        model = fit([texts[i] for i in own], labels[own], weights[own])
        for i in np.flatnonzero(fold == f):
            b, c = texts[i]
            total = c.sum(dtype=np.int64) + NEUTRAL
            logit[i], share[i] = model.bias + float(model.weight[b] @ c) / total, 1 - NEUTRAL / total
    moves = np.arange(-80, 81) / 10
    toxic = logit[None, :] + moves[:, None] * share[None, :] >= 0
    false = toxic[:, labels == 0].mean(1)
    gain = toxic[:, labels == 1].mean(1) - false - 2 * (false > FALSE_ALARMS)
    best = moves[np.flatnonzero(gain >= gain.max() - 1e-9)]
    move, model = best[len(best) // 2], fit(texts, labels, weights)
    short = (labels == 0) & (share < 0.5)
    lower = min(0.0, EMPTY - model.bias)
    if short.any():
        false = [(logit[short] + move * share[short] + d * (1 - share[short]) >= 0).mean() for d in moves[moves <= 0][::-1]]
        lower = min(lower, float(moves[moves <= 0][::-1][np.argmax(np.array([*false[:-1], 0]) <= FALSE_ALARMS)]))
    return Model((model.weight + move - lower).astype(np.float32), model.bias + lower)


_COUNTS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary())])


def _subword_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in byte_slices(batch, "text", 1 << 19):  # a byte is in some eight subwords of 12 bytes each
            key, n = counted(own.column("text"))
            times = -(-n // 0xFFFF)  # a count of more than 16 bits comes in several entries
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            key, n = np.repeat(key, times), np.minimum(np.repeat(n, times) - 0xFFFF * place, 0xFFFF).astype("<u2")
            cut = np.searchsorted(key, np.arange(own.num_rows + 1) * BUCKETS)
            one = (key % BUCKETS).astype("<i4")
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("label"), pa.array([one[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                                              pa.array([n[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], schema=_COUNTS)


def _trained(share: dict[int, int]):
    """The model of the bounded rows of :func:`_subword_counts`; ``share``: labelled rows of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            got += zip(*(batch.column(c).to_pylist() for c in _COUNTS.names))
        got.sort(key=lambda r: (r[0], len(r[2]), r[1]))
        y = np.array([r[1] for r in got])
        weights = np.array([share[k] / (y == k).sum() for k in (0, 1)])[y]
        weights /= weights.mean()
        weights **= 0.75  # between the shares of the classes and equal classes
        texts = [(np.frombuffer(b, "<i4"), np.frombuffer(c, "<u2")) for _, _, b, c in got]
        del got  # fit() replaces each text by what it keeps of it
        model = calibrated(texts, y, weights)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: Column | None = None, train_docs: int = 1200,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``train_docs`` labelled texts of each class, the first by a hash of the id.

    ``rows``: which labelled rows may be used (a condition on ``doc_id``).  Null
    labels and ids take no part; without labels of both classes the model is the
    share of class 1 (0 without any labels)."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(rows) if rows is not None else known
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    own = id_text(docs, id_col, text_col)
    known = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    share = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for k in (0, 1):  # a bounded top-k by hash in each class
        part = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
        picked = part if picked is None else picked.unionByName(part)
    if len(share) < 2:
        p = sum(k * n for k, n in share.items()) / max(1, sum(share.values()))
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if p == 1 else -20.0)
    # the picked ids are bounded, so they go to the texts and no text is shuffled
    counts = own.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").mapInArrow(_subword_counts, "doc_id long, label int, buckets binary, counts binary")
    made = counts.repartition(1).mapInArrow(_trained(share), "weight binary, bias double").first()
    return Model(np.frombuffer(made.weight, "<f4"), made.bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, then the columns ``keep`` as they were.

    Null and empty texts get the bias's score.  Every row is scored by itself, so
    repeated rows and null ids come as they are; an empty table gives no row.
    Very long texts are read in parts of ``PIECE`` bytes, columns not kept are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input
    return with_scores(docs, lambda text: sent.value.scores(text), keep, id_col, text_col)


__all__ = ["BUCKETS", "Model", "subwords", "pieces", "counted", "fit", "calibrated", "train", "score"]
