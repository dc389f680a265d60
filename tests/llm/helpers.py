"""Awkward rows every operator must take: nulls, empty and long texts, repeats, clashing extra columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def words(rng, n, pool=None):
    pool = pool or ["the", "tion", "a", "Ère", "naïve", "über", "re-do", "don't", "12", "x1", "I'll", "日本", "🙂", "end."]
    return " ".join(rng.choice(pool) + (rng.choice(["", "", ",", ".", "\n", "  ", "\t"]) if rng.random() < 0.2 else "") for _ in range(n))


def awkward_texts(seed=5, n=40):
    rng = random.Random(seed)
    fixed = [None, "", " ", "\n", "  a  b ", "a\n\n b\tc", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "a b 　c",
             "it's 'tis ' s", "\x00\x1c\x85", "é" * 50, "aaaa" * 30, "tail ", " head", "word", "word", "  x", "İ ǅ ﬁ ß", "é éx"]
    return fixed + [words(rng, rng.randint(1, 200)) for _ in range(n)]


def frame(spark, texts, start=0, extra=True):
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names the operators use inside
        from pyspark.sql import functions as F
        for name in ("ids", "k", "n", "key", "sequence_id", "score", "packer", "bucket", "line"):
            df = df.withColumn(name, F.lit("extra"))
    return df
