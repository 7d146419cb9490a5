"""The operators' queries, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, embed_dedup, html_extract, kmeans_tree, packing, pii, pivot_negatives, quality, sigtree, token_count, url_filter, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.similar_vectors(table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows.select("conv_id"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return pivot_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def term_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of two frequent words at most three words apart, per document: the index's other kind of match."""
    near = decontam.proximity(table(spark, sf_dir, "documents"), "the", "of", 3)
    return near.groupBy("doc_id").agg(F.count("*").alias("n_near"), F.min(F.least("pos_first", "pos_second")).cast("long").alias("first_at"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_url_filter, op3_quality_classifier, op4_personal_data, op5_token_counts, op6_html_extraction,
        op7_decontamination, op8_warc, op9_best_fit_packing, op10_ngram_jaccard_join, op11_nearest_neighbours, op12_conversation_repair,
        op13_hard_negatives, term_proximity,
    )
}

_DIGEST = "encode(coalesce(html, ''))"
#: SQL for what SQL can express over whole tables; the others are tested against brute force on small fixtures.
ORACLE_SQL = {
    "op8_warc": f"""
        WITH p AS (SELECT page_id, octet_length({_DIGEST}) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first <> page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "term_proximity": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        t AS (SELECT doc_id, w[i + 1] AS word, i AS pos FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w) WHERE w[i + 1] IN ('the', 'of'))
        SELECT a.doc_id, count(*) AS n_near, CAST(min(least(a.pos, b.pos)) AS BIGINT) AS first_at
        FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.word = 'the' AND b.word = 'of' AND abs(a.pos - b.pos) BETWEEN 1 AND 3 GROUP BY a.doc_id
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
        ), p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 10
    """,
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(embedding AS VARCHAR) AS same FROM embeddings
        ), u AS (
            SELECT vec_id, label, e FROM v
            WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r(vec_id, y) AS (SELECT x, y FROM l UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.y = l.x),
        n AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT vec_id, min(y) AS y FROM r GROUP BY vec_id)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.y, v.vec_id)) AS component_id, least(v.vec_id, coalesce(c.y, v.vec_id)) = v.vec_id AS kept
        FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN c ON c.vec_id = v.vec_id
    """,
}
