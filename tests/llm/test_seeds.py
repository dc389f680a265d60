"""Repeated word passages against brute force."""

import random

import numpy as np
import pytest

from lakesync.llm import seeds
from tests.llm.helpers import awkward_texts, frame


def brute(rows, n):
    """(doc_id, text) -> sorted (doc_id, words, spans, kept)."""
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for p in range(len(w) - n + 1):
                key = b" ".join(w[p:p + n])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * (len(w) + 1)
        if i is not None:
            for p in range(len(w) - n + 1):
                if least[b" ".join(w[p:p + n])] < i:
                    gone[p:p + n] = [True] * n
        edges = [p for p in range(len(w) + 1) if gone[p] != (p > 0 and gone[p - 1])]
        out.append((i, len(w), list(zip(edges[::2], edges[1::2])), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def run(df, n, k, **kw):
    return sorted(((r.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in seeds.remove_repeats(df, n, k, **kw).collect()), key=repr)


def shared_texts(seed=1):
    """Passages of many lengths put into documents, whole copies, one word repeated."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["É", "日本", "x y", "ab"]
    passages = [[rng.choice(pool) for _ in range(k)] for k in (5, 12, 13, 14, 25, 80, 200)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(pool) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) - 1)
                parts += p[a:a + rng.randint(1, len(p))]
        out.append(rng.choice([" ", "  ", "\n", "\t"]).join(parts))
    return out + out[:5] + ["a " * 40, "a " * 100, "a " * 12, "\x0b\x0c\x1c a"]


@pytest.mark.parametrize("n,k", [(13, 5), (4, 2), (6, 6), (1, 1)])
def test_equals_brute_force(spark, n, k):
    texts = awkward_texts() + shared_texts()
    rows = [(i % 70 - 5, t) for i, t in enumerate(texts)] + [(None, texts[-9]), (None, None)]
    rows += [(3, texts[-9])] * 2  # an id that repeats
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, n, k) == brute(rows, n)


def test_slices_meet_in_buckets(spark):
    """Many slices and many buckets give what one gives."""
    texts = shared_texts(3)
    df = frame(spark, texts).repartition(7)
    want = brute([(i, t) for i, t in enumerate(texts)], 13)
    assert run(df, 13, 5, slice_bytes=500, bucket_bytes=300) == want


def test_long_text_and_columns(spark):
    """One text of some MB, cut into pieces and blocks; carried columns; an empty table."""
    rng = np.random.default_rng(2)
    long = " ".join(rng.integers(0, 1 << 30, 400_000).astype(str).tolist())
    part = " ".join(long.split(" ")[270_000:270_100])
    df = frame(spark, ["first " + part, long, part, "z" * 3_000_000 + " " + part])
    got = {r.doc_id: r for r in seeds.remove_repeats(df, 13, keep=("lang", "k")).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(270_000, 270_100)] and got[1].n_words == 400_000
    assert bytes(got[1].kept).decode() == long.replace(part + " ", "")
    assert bytes(got[2].kept) == b"" and bytes(got[3].kept) == b"z" * 3_000_000 and (got[0].lang, got[0].k) == ("en", "extra")
    assert seeds.remove_repeats(df.where("doc_id < 0")).collect() == []
