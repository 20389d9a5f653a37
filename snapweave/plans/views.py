"""Snapshot data derived from the driver's tables, and the same views as SQL for the counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.operators.blocks import split_blocks

BLOCK = 1024


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in blocks of 1,024 characters, with a SHA-256 of each."""
    rows = split_blocks(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), BLOCK)
    return rows.withColumn("checksum", F.sha2(F.encode("block", "UTF-8"), 256))


BLOCKS = f"""blocks AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, block, length(block) AS block_size, sha256(block) AS checksum FROM (
    SELECT doc_id, pos, substring(text, pos * {BLOCK} + 1, {BLOCK}) AS block
    FROM (SELECT doc_id, text, unnest(range(0, (length(text) + {BLOCK - 1}) // {BLOCK})) AS pos FROM documents)))"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("snapshotid"), F.col("event_type").alias("scheme"), F.col("ts").alias("timestamp"))


SNAPSHOTS = "snapshots AS (SELECT event_id AS snapshotid, event_type AS scheme, ts AS timestamp FROM events)"


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("segmentid"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("type"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as references: snapshot by week of shipping, segment by order, object by line number; a length of up to 50 bytes of an object of 40."""
    rows = table(spark, sf, "lineitem")
    week = F.date_diff(F.date_trunc("week", "l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) / 7
    return rows.select(week.cast("long").alias("snapshotid"), F.col("l_orderkey").alias("segmentid"), F.col("l_linenumber").cast("long").alias("object"), F.col("l_quantity").cast("long").alias("length"), F.lit(40).cast("long").alias("size"))


REFERENCES = """refs AS (
  SELECT CAST(date_diff('day', DATE '1995-01-02', CAST(date_trunc('week', l_shipdate) AS DATE)) // 7 AS BIGINT) AS snapshotid, l_orderkey AS segmentid,
    CAST(l_linenumber AS BIGINT) AS object, CAST(l_quantity AS BIGINT) AS length, CAST(40 AS BIGINT) AS size FROM lineitem)"""
USED = """used AS (
  SELECT snapshotid, segmentid, object, CAST(CASE WHEN max(length) >= max(size) THEN max(size) ELSE least(sum(length), max(size) - 1) END AS BIGINT) AS size
  FROM refs GROUP BY 1, 2, 3)"""
BYTES = "bytes AS (SELECT snapshotid, segmentid, CAST(sum(size) AS BIGINT) AS bytes_referenced FROM used GROUP BY 1, 2)"
SIZES = "sizes AS (SELECT l_orderkey AS segmentid, CAST(count(DISTINCT l_linenumber) * 40 AS BIGINT) AS data_size FROM lineitem GROUP BY 1)"


def segment_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Data size per segment: 40 bytes for each of its objects."""
    return references(spark, sf).groupBy("segmentid").agg((F.count_distinct("object") * 40).alias("data_size"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "").alias("path"))


PATHS = r"paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
