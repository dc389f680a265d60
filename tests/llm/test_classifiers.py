"""Operators 9 and 10: held-out accuracy, brute-force checks of the maths, awkward rows."""

import itertools
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakesync.llm import quality, toxicity
from lakesync.llm.queries import QUERIES

from .helpers import awkward_texts, frame

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name,folds,held,label,least", [("op9_toxicity", 5, 0, "toxic", 0.93), ("op10_quality", 3, 1, "quality", 0.97)])
def test_held_out_accuracy(spark, name, folds, held, label, least):
    got = QUERIES[name](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert all(h == (zlib.crc32(str(i).encode()) % folds == held) for i, h in zip(got.doc_id, got.held_out))
    known = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    known = known[known.held_out]
    right = known.predicted == known[label]
    balanced = (right[known[label] == 0].mean() + right[known[label] == 1].mean()) / 2
    assert balanced >= least


def labelled(spark, texts, n=120):
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
    return df, labels


def toxic_corpus():
    rng = random.Random(3)
    clean = [f"{a}{b}" for a in ("ther", "lan", "mor", "sti", "ble") for b in ("in", "ou", "est", "ing")]
    return [" ".join(rng.choice(clean) for _ in range(60)) + (" stupendidiot grumbulous" if i % 2 else "") for i in range(120)], clean


def test_misspelled_toxic_words_are_caught(spark):
    texts, clean = toxic_corpus()
    df, labels = labelled(spark, texts)
    model = toxicity.train(df, labels)
    probe = pa.array([" ".join(clean), " ".join(clean) + " stupendidyot grumbulouss stupendidiott", "", "?!"])
    s = model.scores(probe)
    assert s[1] > 0.5 > s[0] and s[2] == s[3]


@pytest.mark.parametrize("method,label", [(toxicity, "toxic"), (quality, "quality")])
def test_awkward_rows(spark, method, label):
    texts = awkward_texts(n=100) + ["z" * 400_000, "a\n" * 30_000] + [None, ""] * 2
    df, labels = labelled(spark, texts)
    nulls = spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 1, 1)], labels.schema)
    model = method.train(df, labels.unionByName(nulls), label)
    got = {r.doc_id: r.score for r in method.score(df, model).collect()}
    assert len(got) == len(texts) and all(0 <= v <= 1 for v in got.values())
    assert got[0] == got[1]  # null and empty
    assert method.score(df.limit(0), model).count() == 0
    for rows in (labels.limit(0), labels.where("quality = 1")):  # nothing or one class to learn from
        one = {r.score for r in method.score(df, method.train(df, rows, label)).collect()}
        assert len(one) == 1
    again = method.train(df.repartition(7), labels.repartition(3), label)
    assert {r.doc_id: r.score for r in method.score(df, again).collect()} == pytest.approx(got)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([0, 1, 5, 5 + 3, 14])
    good, pair = rng.normal(size=14), rng.normal(size=(2, 2))
    _, _, total, p = quality.forward_backward(good, lines, pair)
    for k, (a, b) in enumerate(zip(lines, lines[1:])):
        weight, marginal = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(g for g, v in zip(good[a:b], y) if v) + sum(pair[i, j] for i, j in zip(y, y[1:])))
            weight += w
            marginal += w * np.array(y)
        assert np.isclose(np.log(weight), total[k]) and np.allclose(marginal / weight, p[a:b])


def test_line_features_do_not_cross_texts():
    one = ["A b\nc c c\n\nA b", "", "%%% $$$"]
    x, size, lines = quality.line_features(pa.array(one))
    assert lines.tolist() == [0, 4, 5, 6] and size.tolist() == [3, 5, 0, 3, 0, 7]
    for i, t in enumerate(one):
        alone = quality.line_features(pa.array([t]))[0]
        assert np.allclose(alone, x[lines[i]:lines[i + 1]])


def test_subwords_do_not_cross_texts():
    texts = ["Hello, wor!ld", "", "ab", "a-b\nabc"]
    buckets, rows = toxicity.subwords(pa.array(texts))
    for i, t in enumerate(texts):
        alone, _ = toxicity.subwords(pa.array([t]))
        assert sorted(alone.tolist()) == sorted(buckets[rows == i].tolist())


def test_toxicity_of_long_texts_in_parts(monkeypatch):
    """Cut texts give the subwords of whole ones, counts above 16 bits included; memory follows the part, not the text."""
    import random
    import tracemalloc

    rng = random.Random(6)
    words = ["ab", "Word", "naïve", "x", "ключ", "don't", "日本語テキスト", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = ["", " ", "one", "z" * 700] + ["".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "-", "  "]) for _ in range(rng.randint(1, 400))) for _ in range(25)] + [""]
    column = pa.array(texts)
    buckets, rows = toxicity.subwords(column)
    key, n = np.unique(rows * toxicity.BUCKETS + buckets, return_counts=True)
    model = toxicity.Model(np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32), -0.5)
    whole = model.scores(column)
    logit = [model.bias + model.weight[buckets[rows == i]].sum(dtype=float) / ((rows == i).sum() + toxicity.NEUTRAL) for i in range(len(texts))]
    assert np.allclose(whole, 1 / (1 + np.exp(-np.array(logit))), atol=1e-12)  # a plain loop over the texts
    for size in (1, 40, 1000):
        monkeypatch.setattr(toxicity, "PIECE", size)
        parts = list(toxicity.pieces(column))
        assert b"".join(p.as_py() for _, part in parts for p in part) == "".join(texts).encode()
        assert all(np.array_equal(a, b) for a, b in zip(toxicity.counted(column), (key, n)))
        assert np.allclose(model.scores(column), whole, atol=1e-12)
    monkeypatch.undo()
    long = pa.array(["bad word " * 400_000])  # 3.6 MB
    tracemalloc.start()
    model.scores(long)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), long], ["doc_id", "label", "text"])
    (got,) = toxicity._subword_counts(iter([batch]))
    b, c = np.frombuffer(got.column("buckets")[0].as_py(), "<i4"), np.frombuffer(got.column("counts")[0].as_py(), "<u2")
    key, n = toxicity.counted(long)
    assert np.array_equal(np.bincount(b, c, toxicity.BUCKETS)[key], n) and n.max() >= 400_000
    assert int(toxicity.counted(pa.array([], pa.string()))[1].sum()) == 0 and len(model.scores(pa.array([], pa.string()))) == 0


def test_toxicity_trains_off_the_driver(spark, monkeypatch):
    """The driver gets the model alone: it neither holds the training texts' counts nor fits."""
    driver, real = os.getpid(), toxicity.calibrated

    def here(*given):
        assert os.getpid() != driver, "trained on the driver"
        return real(*given)

    texts = ["you vile fool", "a calm day", "vile vile words", "the river runs"] * 6
    df = frame(spark, texts, extra=False)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(len(texts))], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "calibrated", here)
    model = toxicity.train(df, labels, "toxic")
    assert model.weight.shape == (toxicity.BUCKETS,) and np.isfinite(model.bias) and model.weight.any()
