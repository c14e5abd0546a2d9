"""One registered query per operator, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .chat import digest as chat_digest
from .chat import format_conversations, planted
from .clustering import cluster_vectors
from .common import documents
from .embedding_dedup import near_duplicates
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .language_model import quality, stupid_backoff, trusted_rows
from .packing import pack_documents
from .secrets import digest, scan_secrets
from .tokenize import round_trip
from .toxicity import held_out, score_documents, train_on
from .warc import archive_round_trip
from .whitening import whiten


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_vocabulary(), capacity=2048)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest").drop("text_check")


OP2_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), limit=0.9)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(documents(spark, sf_dir)))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(documents(spark, sf_dir), order=2)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), default_vocabulary())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality(docs, trusted_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), share=0.9)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(*columns)


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    # A null id has no remainder, so it is not held out.
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), words=3, num=90, den=100)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, dim=64, seed=3)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_digest(format_conversations(turns.unionByName(planted(spark))))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, md5(text)), '')) AS loss_sha256,
       CAST(sum(length('<turn ' || role || '>' || chr(10) || replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), most=8, offset=100_000)


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing, "op2_exact_dedup": op2_exact_dedup, "op3_quality": op3_quality, "op4_warc": op4_warc, "op5_embedding_dedup": op5_embedding_dedup, "op6_secret_scan": op6_secret_scan, "op7_stupid_backoff": op7_stupid_backoff, "op8_bpe": op8_bpe, "op9_toxicity": op9_toxicity, "op10_jaccard_join": op10_jaccard_join, "op11_centroid_clustering": op11_centroid_clustering, "op12_chat_formatting": op12_chat_formatting, "op13_whitening": op13_whitening}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op12_chat_formatting": OP12_SQL}
