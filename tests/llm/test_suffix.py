"""Operator 6 against brute force."""

import random

import pytest

from lakesync.llm import suffix

from .helpers import DOCS, awkward_texts, frame


def brute(rows, length):
    """rows: (doc_id, text); removed spans of each row."""
    first = {}
    for d, t in rows:
        if d is not None:
            raw = (t or "").encode()
            for p in range(len(raw) - length + 1):
                w = raw[p:p + length]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        if d is not None:
            for p in range(len(raw) - length + 1):
                if first[raw[p:p + length]] < d:
                    gone[p:p + length] = [True] * length
        spans, begin = [], None
        for i, g in enumerate(gone + [False]):
            if g and begin is None:
                begin = i
            elif not g and begin is not None:
                spans.append((begin, i))
                begin = None
        out.append((d, len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def shape(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3]))


def got(df, length):
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix.remove_repeats(df, length).collect()]


def corpus(seed, n=60, alphabet="abcde é"):
    """Texts with shared passages at all alignments, edits, copies, runs of one byte."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(20, 150))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            kind = rng.random()
            p = p if kind < 0.3 else p[a:b] if kind < 0.7 else p[:a] + rng.choice(alphabet) + p[a + 1:]
            parts += [p, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))]
        out.append("".join(parts))
    return out + ["a" * 300, "a" * 210, "ab" * 100, "x" + "ab" * 90, "a" * 49, "b" + "a" * 60] + rng.sample(out, 6)


@pytest.mark.parametrize("length,seed", [(50, 1), (50, 2), (16, 3), (33, 4)])
def test_removal_equals_brute_force(spark, monkeypatch, length, seed):
    monkeypatch.setattr(suffix, "RUN_BYTES", 2000)
    texts = corpus(seed) + awkward_texts(n=15)
    random.Random(seed).shuffle(texts)
    assert shape(got(frame(spark, texts).repartition(5), length)) == shape(brute(list(enumerate(texts)), length))


def test_ids_repeated_null_and_empty(spark):
    p = "the quick brown fox jumps over the lazy dog and runs away from it all"
    rows = [(5, p), (5, p + "!"), (None, p), (7, "x" + p), (3, "y"), (9, p), (None, None), (2, None), (5, p)]
    df = spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], DOCS)
    assert shape(got(df, 50)) == shape(brute(rows, 50))
    assert got(df.limit(0), 50) == []


def test_kept_columns_follow_their_row(spark):
    df = frame(spark, ["a", "b" * 60, "b" * 60])
    rows = suffix.remove_repeats(df, keep=("lang", "n_chars", "ids")).orderBy("doc_id").collect()
    assert [(r.lang, r.n_chars, r.ids, len(r.kept)) for r in rows] == [("en", 1, "extra", 1), ("en", 60, "extra", 60), ("en", 60, "extra", 0)]


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 20):
        lists = [sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40))}) for _ in range(n)]
        out = list(suffix.merge_runs([suffix.front_code(one) for one in lists]))
        assert [k for k, *_ in out] == sorted(k for one in lists for k in one)
        last = b""
        for key, run, place, known in out:
            assert lists[run][place] == key
            assert known == suffix.shared_prefix(last, key, 0)
            last = key


def test_prefixes_are_not_compared_again(monkeypatch):
    """Bytes read by the merge stay near the keys' own length, whatever they share."""
    read = []
    plain = suffix.shared_prefix
    monkeypatch.setattr(suffix, "shared_prefix", lambda a, b, s: (read.append((n := plain(a, b, s)) - s + 1), n)[1])
    runs = [suffix.front_code([b"p" * 200 + bytes((i, r)) for i in range(100)]) for r in range(8)]
    read.clear()
    assert len(list(suffix.merge_runs(runs))) == 800
    assert sum(read) < 800 * 20
