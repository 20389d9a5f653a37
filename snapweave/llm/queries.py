"""The numbered queries: thin wrappers that apply an operator to its whole table and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm import ann, bpe, chat, classifier, jaccard, packing, pii, quality, substrings, warc
from snapweave.llm._common import new_path, table, written


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, t, r, "\\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))], said.schema)
    return chat.digests(chat.reconstruct(chat.message_events(said.unionByName(more)), thread_col="thread"), dealt=True)


def op4_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_OP3 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + 2 * length(role) - length(regexp_replace(role, '[\\#<:]', '', 'g')) + 2 * length(text) - length(regexp_replace(text, '[\\#<:]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = written(warc.read(spark, path, bodies=False), "records")
    captures = warc.captures(records, with_body=False)
    flat = captures.select("record_id", "page_id", F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.digest").alias("payload_digest"), F.col("capture.record_type").alias("record_type"), F.col("capture.refers_to").alias("target_id"))
    return warc.resolved(written(flat, "captures")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP7 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
m AS (SELECT sha256(payload) AS k, max(page_id) AS last FROM p WHERE octet_length(payload) >= 1000 GROUP BY 1)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN m ON octet_length(payload) >= 1000 AND sha256(payload) = k
"""


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_quality, op3_chat, op4_classifier, op5_pii, op6_substrings, op7_warc, op8_ann, op9_jaccard, op10_pack)}
ORACLES: dict[str, str] = {"op3_chat": ORACLE_OP3, "op7_warc": ORACLE_OP7}
