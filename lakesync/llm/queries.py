"""Registered queries of this package: thin callers that derive the digest columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakesync.llm import bpe, counts, merkle, nndescent, packing, partenum, pivot, quality, seeds, suffix, toxicity, urlrules, whiten
from lakesync.llm.common import table
from lakesync.llm.vectors import usable


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "tier", F.col("step_group.step").alias("step"))


def op2_bpe(spark, sf_dir):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_counts(spark, sf_dir):
    counted = counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_nn_descent(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    return nndescent.knn(own, own.where("vec_id % 100 = 0"), 10)


def op5_pivot_topk(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    ints = own.where(usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("embedding"))
    best = pivot.top_inner(ints, ints.where("vec_id % 50 = 0"), 5)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op6_suffix_dedup(spark, sf_dir):
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# the given rules: host and subdomains, path prefix, verdict
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op7_url_filter(spark, sf_dir):
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_jaccard_join(spark, sf_dir):
    return partenum.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def fold(folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def _classified(spark, sf_dir, method, label, folds, held):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = method.train(docs, labels, label, rows=fold(folds) != held)
    return method.score(docs, model).select("doc_id", (fold(folds) == held).alias("held_out"), "score",
                                            (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark, sf_dir):
    return _classified(spark, sf_dir, toxicity, "toxic", 5, 0)


def op10_quality(spark, sf_dir):
    return _classified(spark, sf_dir, quality, "quality", 3, 1)


def op11_whitening(spark, sf_dir):
    # a vector that takes no part becomes null: its components may not fit a long
    whole = F.transform("embedding", lambda c: F.floor(64 * c.cast("double")) + 1000000)
    ints = table(spark, sf_dir, "embeddings").select("vec_id", F.when(usable(F.col("embedding")), whole).alias("embedding"))
    return whiten.whiten(ints, 32)


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(fold(3) == 0, F.translate("text", _UPPER, _UPPER.lower())).otherwise(F.col("text"))
    rows = merkle.manifest(docs, MANIFEST_FIELDS, changed=tuple(F.col(c) for c in MANIFEST_FIELDS[:-1]) + (tampered,))
    return merkle.checked(rows).select("doc_id", *[F.lower(F.hex(c)).alias(name) for c, name in (
        ("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))],
        (F.col("folded") == F.col("root")).alias("verified"))


def op13_seed_dedup(spark, sf_dir):
    out = seeds.remove_repeats(table(spark, sf_dir, "documents"), 13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_packing": op1_packing, "op2_bpe": op2_bpe, "op3_token_counts": op3_token_counts, "op4_nn_descent": op4_nn_descent, "op5_pivot_topk": op5_pivot_topk,
           "op6_suffix_dedup": op6_suffix_dedup,
           "op7_url_filter": op7_url_filter,
           "op8_jaccard_join": op8_jaccard_join, "op9_toxicity": op9_toxicity, "op10_quality": op10_quality,
           "op11_whitening": op11_whitening, "op12_manifest": op12_manifest, "op13_seed_dedup": op13_seed_dedup}
ORACLES: dict[str, str] = {
    "op5_pivot_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
        SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5""",
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (
            SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
            FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d WHERE length(h) >= 100)),
        c AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
        marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER own + 50, TRUE)::INTEGER AS begins FROM c WINDOW own AS (PARTITION BY doc_id ORDER BY p)),
        numbered AS (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
        runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run),
        cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_byte FROM runs),
        kept AS (
            SELECT d.doc_id, any_value(length(d.h) // 2) AS n_bytes, coalesce(sum(b - a), 0) AS n_removed, count(a) AS n_spans, coalesce(max(b), 0) AS tail,
                   coalesce(string_agg(substr(h, 2 * from_byte + 1, 2 * (a - from_byte)), '' ORDER BY a), '') AS head, any_value(h) AS h
            FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id GROUP BY d.doc_id)
        SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
               sha256(unhex(head || substr(h, 2 * tail + 1))) AS kept_sha256 FROM kept""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        close AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        links AS (SELECT a, b FROM close UNION ALL SELECT b, a FROM close),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.r) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.doc_id = d.doc_id GROUP BY 1, 2""",
    "op12_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, hex(encode(doc_id::VARCHAR)) AS id FROM documents),
        crc AS (
            SELECT DISTINCT id, 4294967295::BIGINT AS c, 0 AS bits FROM d UNION ALL
            SELECT id, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, bits + 1
            FROM (SELECT id, bits, CASE WHEN bits % 8 = 0 THEN xor(c, ('0x' || substr(id, bits // 4 + 1, 2))::BIGINT) ELSE c END AS x
                  FROM crc WHERE bits < 4 * length(id))),
        l AS (
            SELECT d.doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || CASE WHEN xor(c, 4294967295) % 3 = 0 THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS given
            FROM d JOIN crc ON crc.id = d.id AND crc.bits = 4 * length(d.id)),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n,
                   dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM l),
        up AS (
            SELECT grp, 0 AS lvl, rank, n, leaf AS h FROM leaves UNION ALL
            SELECT grp, lvl + 1, rank // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY rank)) FROM up WHERE n > 1 GROUP BY grp, lvl, rank // 8),
        subroots AS (SELECT grp, lvl, h, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (
            SELECT 0 AS lvl, grp AS rank, n, h FROM subroots UNION ALL
            SELECT lvl + 1, rank // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY rank)) FROM top WHERE n > 1 GROUP BY lvl, rank // 8),
        met AS (
            SELECT a.grp, a.lvl, a.rank, coalesce(string_agg(b.h, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS before,
                   coalesce(string_agg(b.h, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS after
            FROM up a JOIN up b ON a.grp = b.grp AND a.lvl = b.lvl AND a.rank // 8 = b.rank // 8 WHERE a.n > 1 GROUP BY 1, 2, 3
            UNION ALL
            SELECT -1, a.lvl, a.rank, coalesce(string_agg(b.h, '' ORDER BY b.rank) FILTER (b.rank < a.rank), ''), coalesce(string_agg(b.h, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '')
            FROM top a JOIN top b ON a.lvl = b.lvl AND a.rank // 8 = b.rank // 8 WHERE a.n > 1 GROUP BY a.lvl, a.rank),
        folds AS (
            SELECT l.doc_id, l.leaf, l.grp, s.h AS subroot, s.lvl AS height, l.rank, 0 AS lvl, l.given AS h, '' AS proof FROM leaves l JOIN subroots s ON s.grp = l.grp
            UNION ALL
            SELECT f.doc_id, f.leaf, f.grp, f.subroot, f.height, CASE WHEN f.lvl + 1 = f.height THEN f.grp ELSE f.rank // 8 END, f.lvl + 1,
                   sha256(m.before || f.h || m.after), f.proof || m.before || m.after
            FROM (SELECT *, CASE WHEN lvl >= height THEN -1 ELSE grp END AS tree, CASE WHEN lvl >= height THEN lvl - height ELSE lvl END AS own,
                         CASE WHEN height = 0 AND lvl = 0 THEN grp ELSE rank END AS place FROM folds) f
            JOIN met m ON m.grp = f.tree AND m.lvl = f.own AND m.rank = f.place),
        ends AS (SELECT * FROM folds WHERE lvl = height + (SELECT max(lvl) FROM top))
        SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root,
               h = (SELECT h FROM top WHERE n = 1) AS verified FROM ends""",
    "op13_seed_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        c AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p)),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM c WHERE gone)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(any_value(r.n), 0)::BIGINT AS n_removed, sha256(coalesce(any_value(k.t), '')) AS kept_sha256
        FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1) r ON r.doc_id = d.doc_id
        LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY 1) k ON k.doc_id = d.doc_id
        GROUP BY d.doc_id, d.w""",
}
