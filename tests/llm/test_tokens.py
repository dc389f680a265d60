"""Operators 1 to 3 against the libraries on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakesync.llm import bpe, counts, packing, tokens

from .helpers import DOCS, awkward_texts, frame, words


@pytest.fixture(scope="module")
def reference_bpe():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def fuzz(n=300, seed=3):
    rng = random.Random(seed)
    pools = ["abcdefghij  \n.,'", "tionthe erin", " \t\n\r\x0b\x1c\x85  ", "aàéñß ŒИж日🙂 ", "'s't've'll 12²Ⅷ", "<|endoftext|> ",
             "aab ba aba", "".join(map(chr, range(32, 127)))]
    return ["".join(rng.choice(p) for _ in range(rng.randint(0, 60))) for p in (rng.choice(pools) for _ in range(n))]


def test_bpe_equals_library_and_round_trips(spark, reference_bpe):
    texts = awkward_texts() + fuzz()
    out = bpe.decode(bpe.encode(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r.doc_id] or ""
        assert r.ids == reference_bpe.encode_ordinary(text), text
        assert bytes(r.decoded) == text.encode()


def test_bpe_every_character(spark, reference_bpe):
    """One text for each assigned plane-0 and -1 character, beside letters, digits and spaces."""
    tok = bpe.rank_tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    chars = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}  {chr(c)}" for c in chars]
    bad = [hex(c) for c, t, e in zip(chars, texts, tok.encode_batch(texts)) if e.ids != reference_bpe.encode_ordinary(t)]
    assert bad == []


def test_bpe_ties_of_cuts(reference_bpe):
    tok = bpe.rank_tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(8)
    syllables = ["a", "b", "ab", "ba", "an", "na", "ing", "tion", "on", "it", "ti", "st", "ts", "er", "re", "the", "=", "==", "-", "in"]
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 30))) for _ in range(20000)]
    assert [t for t, e in zip(texts, tok.encode_batch(texts)) if e.ids != reference_bpe.encode_ordinary(t)] == []


def test_bpe_offsets_are_bytes(spark):
    texts = ["héllo wörld 🙂", "", "ab"]
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {v: k for k, v in bpe.read_ranks(path).items()}
    for r in bpe.encode(frame(spark, texts), path, P.PATTERN, offsets=True).collect():
        raw = texts[r.doc_id].encode()
        assert [raw[s:s + len(ranks[i])] for s, i in zip(r.starts, r.ids)] == [ranks[i] for i in r.ids]


def test_decode_split_character(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    whole = bpe.encode(frame(spark, ["🙂"]), path, P.PATTERN).first().ids
    assert len(whole) > 1
    rows = bpe.decode(spark.createDataFrame([(1, whole), (2, whole[:1]), (3, None)], "doc_id long, ids array<int>"), path).orderBy("doc_id").collect()
    assert bytes(rows[0].decoded).decode() == "🙂" and 0 < len(rows[1].decoded) < 4 and len(rows[2].decoded) == 0


def test_bpe_workers_hold_a_bounded_share(reference_bpe):
    """Long parts empty the table of parts; long id lists are decoded few at a time."""
    path = P.path("byte_bpe_50k.tiktoken")
    parts = tokens.PartTable(tokens.joined_encoder(bpe.rank_tokenizer(path, P.PATTERN), "", tokens._SPACED), limit=100)
    rng = random.Random(4)
    for _ in range(30):
        text = "".join(rng.choice("abcdefgh") for _ in range(2000))
        ids, _ = tokens.encode_column(parts, pa.array([text]), tokens.spaced_parts)
        assert ids.tolist() == reference_bpe.encode_ordinary(text)
        assert parts.known.nbytes + parts.flat.nbytes < 64 * 100 + 20_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "ids": pa.array([[1] * 40, None, [], [2] * 90, [3] * 70], pa.list_(pa.int32()))})
    runs = [r.column("doc_id").to_pylist() for r in bpe.id_slices(batch.slice(0, 5), 100)]
    assert runs == [[0, 1, 2], [3], [4]]


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (700, 300), (200, 150)])
def test_counts_equal_library(spark, chunk, overlap):
    rng = random.Random(1)
    texts = awkward_texts() + fuzz(100) + [words(rng, 3000), "x" * 5000, " " * 3000, "\n \t" * 900, "a<|endoftext|>" * 300, "don't've " * 500,
                                           "word " * 100 + "y" * 2000 + " word" * 100]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in counts.count_tokens(frame(spark, texts), P.path("byte_bpe_50k.json"), chunk, overlap).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)), t


def test_counts_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c " * 300, "", "", 0)] * 2 + [(None, "a", "", "", 0)], DOCS)
    got = counts.count_tokens(df, P.path("byte_bpe_50k.json"), 500, 100).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[0] == (0, 1) and len(got) == 3
    assert counts.count_tokens(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def check_pieces(texts, rows, tiers):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert np.frombuffer(r.ids, "<u4").tolist() == own[r.start:r.start + r.length]
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
    for i, own in ids.items():
        at = 0
        for s, n in sorted(covered[i]):
            assert s == at and n > 0
            at += n
        assert at == len(own)
    padded = 0
    for seq in sequences.values():
        at = 0
        for o, n, t in sorted(seq):
            assert o == at
            at += n
        assert at <= t and t in tiers
        padded += at < t
    return padded


def test_packing_is_complete_and_full(spark):
    rng = random.Random(2)
    texts = awkward_texts(n=200) + [words(rng, 9000)] + ["", None] * 5
    rows = packing.pack(frame(spark, texts).repartition(5), P.path("word_bpe_49k.json")).collect()
    assert check_pieces(texts, rows, packing.TIERS) <= 1
    steps = defaultdict(int)
    for r in rows:
        steps[r.step_group] += r.length
    assert max(steps.values()) <= 1 << 18


def test_packing_small_tiers_and_balance(spark):
    texts = awkward_texts(seed=9, n=120)
    rows = packing.pack(frame(spark, texts).repartition(4), P.path("word_bpe_49k.json"), tiers=(8, 16, 32, 64), step_tokens=256, fan_in=2).collect()
    assert check_pieces(texts, rows, (8, 16, 32, 64)) <= 2
    size = defaultdict(int)
    for r in rows:
        size[r.step_group] += r.length
    short = [k for k, v in size.items() if v != 256]
    assert len(short) <= 2 * 4  # the last step of a tier, and those with a padded sequence


def test_packing_repeats_nulls_empty(spark):
    df = spark.createDataFrame([(7, "a b", "", "", 0)] * 3 + [(None, "c", "", "", 0)], DOCS)
    rows = packing.pack(df, P.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in rows) == 3 * 3 + 2
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0
    assert all(zlib.crc32(bytes(r.ids)) >= 0 for r in rows) and F is not None


def test_packing_refuses_tokenizers_it_would_change(spark):
    """A byte-level tokenizer keeps capitals and white space."""
    docs = spark.createDataFrame([(1, "Ab  cD")], "doc_id long, text string")
    with pytest.raises(ValueError, match="lower case"):
        packing.pack(docs, P.path("byte_bpe_50k.json"))
    assert packing.pack(docs, P.path("word_bpe_49k.json")).count() == 1
