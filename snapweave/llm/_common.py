"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where unset, a new temporary one is set, but only in local mode: on a cluster executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="snapweave-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of an Arrow batch: Spark's default of 10,000 is for narrow rows; of whole texts so many need tens of MB in the JVM and in Python at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Folders and tables of intermediate results that this driver has written so far.
_left: list[tuple[str, str | None]] = []


def _small_batches(spark: SparkSession) -> None:
    """Sets the rows of Arrow batches for this session, where they have the default."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def new_path(spark: SparkSession, name: str, own: str | None = None) -> str:
    _small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append((path, own))
    return path


def mark() -> int:
    """How many intermediate results there are so far."""
    return len(_left)


def release(spark: SparkSession, since: int, keep: Iterable[str] = ()) -> None:
    """Deletes the intermediate results written after ``mark`` gave ``since``, but for the folders to ``keep``; call it when all that was computed from them is stored."""
    kept = []
    while len(_left) > since:
        path, own = _left.pop()
        if path in keep:
            kept.append((path, own))
            continue
        if own:
            spark.sql(f"DROP TABLE IF EXISTS {own}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _left.extend(kept)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and lost executors cost no rework of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, and read again: where it meets something else by ``key``, only the other side is shuffled."""
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    path = new_path(spark, name, own)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(own)
    return spark.table(own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns freed memory to the system: a Python worker stays for the next task, beside the executor's JVM, and would keep the most that it ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the C library on Linux only
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[list[list]]:
    """Columns of consecutive rows as lists, cut so that the texts of one chunk stay near ``most`` characters."""
    try:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            cols = [c.to_pylist() for c in batch.columns]
            start = size = 0
            for i, t in enumerate(cols[text]):
                size += len(t or "")
                if size >= most:
                    yield [c[start : i + 1] for c in cols]
                    start, size = i + 1, 0
            if start < len(cols[text]):
                yield [c[start:] for c in cols]
    finally:
        give_back()


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a string column, null as empty."""
    return F.encode(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), "UTF-8")


def _bitmap(rows: DataFrame, keys: DataFrame, key: str, bits: int, how: str) -> tuple[DataFrame, Column]:
    """``rows`` joined with a bitmap of the hashed ``keys``, ``2**bits`` bits whatever the data, and whether a row's ``key`` is in it."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    maps = keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap_"))
    met = rows.withColumn("at_", place).join(F.broadcast(maps), F.bitmap_bucket_number("at_") == F.col("bucket_"), how)  # at most 2**bits bits
    position = F.bitmap_bit_position("at_")
    byte = F.conv(F.hex(F.substring("bitmap_", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met, F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def bitmap_filter(rows: DataFrame, keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``keys``, so that wide rows that a join would drop need no shuffle."""
    met, hit = _bitmap(rows, keys, key, bits, "inner")
    return met.where(hit).select(*rows.columns)


def anti_join(rows: DataFrame, keys: DataFrame, key: str, bits: int = 24) -> DataFrame:
    """``rows`` whose ``key`` is null or not in ``keys``: those that a bitmap tells apart pass as they are, only the others are shuffled to ``keys``."""
    met, hit = _bitmap(rows, keys, key, bits, "left")
    hit = F.coalesce(hit, F.lit(False))
    doubt = met.where(hit).select(*rows.columns).join(keys.select(F.col(key).alias("key_of_gone_")), F.col(key) == F.col("key_of_gone_"), "left_anti")
    return met.where(~hit).select(*rows.columns).unionByName(doubt)


def semi_join(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``keys``, filtered by a bitmap before they are shuffled."""
    # an inner join, as a semi join would be pushed below the bitmap
    return bitmap_filter(rows, keys, key).join(keys.select(key).distinct(), key).select(*rows.columns)
