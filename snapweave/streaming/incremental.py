"""An extension: taking in new blocks as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_blocks(blocks: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first of equal blocks (checksum and size) that arrive within ``delay`` of each other; state older than that is dropped."""
    return blocks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["checksum", "size"])


def scheme_counts(snapshots: DataFrame, time: str = "ts", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Snapshots per scheme and window of time; a window is final once the watermark has passed it."""
    return snapshots.withWatermark(time, delay).groupBy(F.window(time, window), "scheme").agg(F.count("*").alias("snapshots")).select(F.col("window.start").alias("start"), "scheme", "snapshots")


def append_utilization(refs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the live bytes of each micro-batch's snapshots to the table at ``path``, one folder per batch, so a batch that runs twice replaces itself."""
    from snapweave.operators.account import segment_bytes, use_objects

    def batch(df: DataFrame, no: int) -> None:
        segment_bytes(use_objects(df)).write.mode("overwrite").parquet(f"{path}/batch={no}")

    return refs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
