"""The registered queries of the operators of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, katz, minhash, mixing, packing, quality, scoring, token_files, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(manifest, with_payload=False).drop("url")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = scoring.id_hash("doc_id", 7) == 2
    scores = katz.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out).scores
    return scores.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), scoring.id_hash("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = quality.score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_files.read(manifest, with_ids=False)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), length=4, similarity=0.8)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), scoring.id_hash("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups_of(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_katz": op3_katz,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_topk": op6_topk,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_warc": """
        WITH hashed AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
        ), grouped AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload) AS keep FROM hashed
        )
        SELECT page_id, n::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1), 1)), '') AS payload_digest,
            CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
        FROM grouped
    """,
    "op2_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), hashed AS (
            SELECT *, md5(concat_ws(' ', doc_id::VARCHAR, size::VARCHAR)) AS h FROM sized
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), ranked AS (
            SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS r FROM sources
        ), weighed AS (
            SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2 * source_size AS lim FROM ranked
        ), ends AS (
            SELECT *, lim / w AS e FROM weighed
        ), levels AS (
            SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE
                - coalesce(sum(lim) OVER (ORDER BY e, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / sum(w) OVER (ORDER BY e, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM ends
        ), level AS (
            SELECT (SELECT l FROM levels WHERE l <= e ORDER BY e, r LIMIT 1) AS v
        ), goals AS (
            SELECT source, source_size, r, w, CASE WHEN v IS NULL OR e <= v THEN lim::DOUBLE ELSE w * v END AS target FROM levels, level
        ), queue AS (
            SELECT doc_id, h, size, source_size, target, w, r,
                sum(size) OVER (PARTITION BY hashed.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens
            FROM hashed JOIN goals ON hashed.source IS NOT DISTINCT FROM goals.source
        ), copies AS (
            SELECT *, (epoch * source_size + tokens)::DOUBLE / w AS fin FROM queue, (VALUES (0), (1)) AS epochs(epoch)
        ), mixed AS (
            SELECT *, sum(size) OVER (ORDER BY fin, r, epoch ROWS UNBOUNDED PRECEDING) <= 1.5 * (SELECT sum(size) FROM sized) AS taken
            FROM copies WHERE size > 0
        )
        SELECT doc_id, size, source_size, target, (size * count(*) FILTER (WHERE taken))::BIGINT AS taken FROM mixed GROUP BY doc_id, h, size, source_size, target
        UNION ALL SELECT doc_id, size, source_size, target, 0 FROM queue WHERE size = 0
    """,
    "op6_topk": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
            FROM (SELECT * FROM vectors WHERE vec_id % 20 = 0) q, vectors d WHERE q.vec_id <> d.vec_id
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
        ) WHERE rank <= 20
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
