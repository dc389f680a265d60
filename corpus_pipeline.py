"""A corpus pipeline: quality, toxicity, near copies, repeated passages, packing.

``STAGES`` are run in order; each takes what its predecessor kept, as written
and read again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.llm import packing, partenum, quality, suffix, toxicity
from lakesync.llm.common import passing, stored, table, unzipped, zipped
from lakesync.llm.queries import fold, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _scored(spark, docs, sf_dir, method, label, folds, held) -> DataFrame:
    model = method.train(docs, table(spark, sf_dir, "labels"), label, rows=fold(folds) != held)
    return method.score(docs, model, keep=COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF (operator 10) does not reject."""
    return _scored(spark, docs, sf_dir, quality, "quality", 3, 1).where("score >= 0.5").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier (operator 9) does not call toxic."""
    return _scored(spark, docs, sf_dir, toxicity, "toxic", 5, 0).where("score < 0.5").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (operator 8: five words, similarity 0.8) the least doc_id.

    Rows that share an id stay or go together; rows without an id stay."""
    with passing(spark):
        groups = partenum.jaccard_components(docs, words=5, percent=80)
        kept = stored(groups.where("doc_id = component_id").select("doc_id").distinct(), "kept-ids", outlives=True)
    # texts are shuffled compressed; a broadcast would have each task pack and unpack them, with two Python workers
    rows = docs.where("doc_id is not null").select(*COLUMNS)
    packed = rows.mapInArrow(zipped, rows.drop("text").withColumn("z", F.lit(None).cast("binary")).schema).join(kept.hint("merge"), "doc_id", "left_semi")
    texts = packed.mapInArrow(unzipped, packed.drop("z").withColumn("text", F.lit(None).cast("binary")).schema)
    return texts.withColumn("text", F.col("text").cast("string")).select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that start in earlier documents (operator 6).

    A character that loses some of its bytes goes whole.  A document of which
    nothing is left stays, with an empty text."""
    out = suffix.remove_repeats(docs, 50, keep=("lang", "source"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.size("spans") > 0, F.replace(text, F.lit("\ufffd"), F.lit(""))).otherwise(text)
    return out.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens (operator 1), a row per piece."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "tier", F.col("step_group.step").alias("step"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack_documents),
]

# classifiers, packing and byte-level removal have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
