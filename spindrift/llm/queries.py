"""The queries opN_<name> of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import ann, bpe, embedding_dedup, lm_score, packing, pii, simhash, token_io, toxicity, warc
from spindrift.llm._store import small_batches

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("documents", "pages"):
        small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, capacity=4096, digests=True)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.bpe_encode(_table(spark, sf_dir, "documents"), BYTE_BPE, keep=["doc_id"])
    both = bpe.bpe_decode(ids, BYTE_BPE)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.embedding_near_dedup(_table(spark, sf_dir, "embeddings"), least=0.98)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"), folds=7, held=2)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_dedup(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.warc_round_trip(_table(spark, sf_dir, "pages"), payloads=False, least=1000)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), folds=4, held=2)
    scored = toxicity.score_texts(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_io.token_round_trip(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_bpe_round_trip, op3_embedding_near_dedup, op4_lm_score, op5_simhash_dedup, op6_warc_round_trip, op7_nearest_neighbours, op8_contextual_pii, op9_toxicity, op10_token_files)}

ORACLE_SQL = {
    "op3_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_sum([x * x FOR x IN e]) > 0),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
        c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY x)
        SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
    """,
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
        FROM m
    """,
}
