"""Who uses how much of which segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def use_objects(refs: DataFrame, keys: tuple[str, ...] = ("snapshotid", "segmentid", "object"), length: str = "length", size: str = "size") -> DataFrame:
    """Bytes of each object that references use: all of it if one takes it whole, else the sum of the parts, but less than all.

    The result doesn't depend on the references' order. Objects of no size give no row.
    """
    full = F.max(size)
    used = F.when(F.max(length) >= full, full).otherwise(F.least(F.sum(length), full - 1))
    return refs.groupBy(*keys).agg(used.alias("used"), full.alias("full")).where("full > 0").drop("full").withColumnRenamed("used", size)


def segment_bytes(used: DataFrame, keys: tuple[str, ...] = ("snapshotid", "segmentid"), size: str = "size") -> DataFrame:
    """Live bytes per snapshot and segment."""
    return used.groupBy(*keys).agg(F.sum(size).alias("bytes_referenced"))


def utilization(bytes_used: DataFrame, segments: DataFrame, snapshots: list[int] | None = None) -> DataFrame:
    """``segmentid, bytes_referenced, data_size, utilization``: the most that one of the snapshots uses of a segment."""
    rows = bytes_used if snapshots is None else bytes_used.where(F.col("snapshotid").isin(snapshots))
    most = rows.groupBy("segmentid").agg(F.max("bytes_referenced").alias("bytes_referenced"))
    return most.join(segments.select("segmentid", "data_size"), "segmentid").withColumn("utilization", F.col("bytes_referenced").cast("double") / F.col("data_size"))


def used_segments(segments: DataFrame, refs: DataFrame) -> DataFrame:
    return segments.join(refs.select("segmentid"), "segmentid", "left_semi")


def segment_info(segments: DataFrame, used: DataFrame, blocks: DataFrame) -> DataFrame:
    """Segments with the size and newest time of their blocks, the greatest utilization, and the whole bytes that it makes."""
    size = blocks.groupBy("segmentid").agg(F.sum("size").alias("size"), F.max("timestamp").alias("mtime"))
    most = used.groupBy("segmentid").agg(F.max("utilization").alias("utilization"))
    return segments.join(size, "segmentid", "left").join(most, "segmentid", "left").withColumn("used", (F.col("size") * F.col("utilization")).cast("long"))


def written_bytes(objects: DataFrame, group: str = "group") -> DataFrame:
    return objects.groupBy(group).agg(F.sum("size").alias("bytes"), F.sum("stored_size").alias("stored_bytes"))
