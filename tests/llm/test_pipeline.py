"""The stages of the pipeline, each against a brute-force version on its own input."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from lakesync.llm import toxicity
from lakesync.session import child_folders, shared_dir

from .helpers import DOCS, awkward_texts, frame
from .test_partenum import brute as brute_components
from .test_suffix import brute as brute_spans
from .test_suffix import corpus

SF = "/root/testdata/sf0.01"


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stage_names_and_order():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "suffix-array dedup", "packing"]


def test_filters_keep_rows_as_they_were(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = C.keep_quality(spark, docs, SF)
    assert good.columns == list(C.COLUMNS) and good.exceptAll(docs.select(*C.COLUMNS)).isEmpty()
    left = {r.doc_id for r in good.select("doc_id").collect()}
    wrong = [d for d, r in labels.items() if (d in left) != (r.quality == 1)]
    assert len(wrong) <= 0.05 * len(labels)
    clean = C.drop_toxic(spark, docs, SF)
    left = {r.doc_id for r in clean.select("doc_id").collect()}
    lost = [d for d, r in labels.items() if r.toxic == 0 and d not in left]
    assert len(lost) <= 0.05 * len(labels) and clean.exceptAll(docs.select(*C.COLUMNS)).isEmpty()


def test_empty_and_short_clean_texts_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*C.COLUMNS)
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").select("doc_id")
    starts = [r.text.split() for r in docs.join(clean, "doc_id").where("length(text) > 200").orderBy("doc_id").limit(300).collect()]
    texts = [None, "", " ", "?!", "\n\n"] + [" ".join(w[:1 + i % 12]) for i, w in enumerate(starts)]
    more = frame(spark, texts, start=10_000_000).select(*C.COLUMNS)
    left = {r.doc_id - 10_000_000 for r in C.drop_toxic(spark, docs.unionByName(more), sf).where("doc_id >= 10000000").collect()}
    assert left >= set(range(5))
    assert len(left) >= 5 + 0.95 * 300


def test_empty_texts_are_clean_when_most_labels_are_toxic():
    word = [np.array([k], np.int32) for k in range(2)]
    texts = [(word[i % 10 > 0], np.array([50], np.uint16)) for i in range(200)]
    labels = np.array([int(i % 10 > 0) for i in range(200)])
    model = toxicity.calibrated(texts, labels, np.ones(200))
    assert model.scores(pa.array(["", "?!"])).max() < 0.5
    assert all((model.bias + model.weight[k] * 50 / (50 + toxicity.NEUTRAL) >= 0) == (k == 1) for k in (0, 1))


def test_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    want = [d for d, _, c in brute_components(rows(docs), 5, 80) if d == c]
    assert sorted(r.doc_id for r in C.one_of_each_group(spark, docs, SF).collect()) == sorted(want)


def scratch(spark) -> set[str]:
    root = f"{shared_dir(spark)}/lakesync"
    return {f"{f}/{name}" for f in child_folders(spark, root) for name in child_folders(spark, f"{root}/{f}")}


def test_stages_leave_no_scratch_behind(spark):
    """What a stage wrote on its way went with it; only what its result reads stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    for stage, stays in ((C.one_of_each_group, "kept-ids"), (C.drop_repeats, "places")):
        before = scratch(spark)
        out = stage(spark, docs, SF)
        assert [p.split("/")[1] for p in scratch(spark) - before] == [stays]
        assert out.count() and not before - scratch(spark)


def test_texts_come_back_from_their_shuffle_as_they_were(spark, monkeypatch):
    texts = ["A b\r\n\u00e9 \U0001f600 \x00 end", None, "", " ", "x" * 70_000, "y " * 3_000_000]
    own = [(None if i == 3 else i, t, None if i == 4 else "en", "web", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(C.partenum, "jaccard_components", lambda d, **kw: d.select("doc_id", F.col("doc_id").alias("component_id")))
    out = C.one_of_each_group(spark, docs, SF)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, own))
    # the texts go through the join as compressed bytes
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow unzipped") < plan.index("LeftSemi") < plan.index("MapInArrow zipped")


def test_repeats_go(spark):
    texts = corpus(7) + awkward_texts(n=5)
    got = {r.doc_id: r for r in C.drop_repeats(spark, frame(spark, texts), SF).collect()}
    assert len(got) == len(texts)
    for d, _, spans, kept in brute_spans(list(enumerate(texts)), 50):
        want = kept.decode(errors="replace").replace("�", "") if spans else kept.decode()
        assert got[d].text == want and got[d].n_chars == len(want)


def test_stages_take_awkward_rows(spark):
    odd = spark.createDataFrame([(None, "no id", None, None, None), (3, None, None, None, None), (3, None, None, None, None)], DOCS)
    docs = frame(spark, awkward_texts(n=5), start=10, extra=False).unionByName(odd)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(C.COLUMNS)
        assert out.count() <= docs.count() and stage(spark, docs.limit(0), SF).count() == 0
    assert C.pack_documents(spark, docs, SF).count() > 0


def test_run_is_complete(spark):
    pieces = C.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in by_doc.values():
        at = 0
        for s, n, total in sorted(parts):
            assert s == at
            at += n
        assert at == total
    for seq in sequences.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 4096
    # what is left: kept by every stage, run one by one
    now = docs
    for _, stage in C.STAGES[:-1]:
        now = stage(spark, now, SF)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in now.select("doc_id", "text").collect()}
    assert {d: p[0][2] for d, p in by_doc.items()} == want and re and F
