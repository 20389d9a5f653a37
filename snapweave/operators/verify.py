"""Checking files against their stored size and checksum."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Bytes of each reference (``segment, object, start, length, exact, kind``): ``content``, and ``fetch_ok``.

    ``zero`` references give zero bytes. A slice must lie inside its object, an exact one must be all of it.
    """
    both = refs.join(objects.select("segment", "object", F.col("content").alias("whole")), ["segment", "object"], "left")
    size = F.length("whole")
    cut = F.when(F.col("length").isNull(), F.col("whole")).otherwise(F.substring(F.col("whole"), (F.col("start") + 1).cast("int"), F.col("length").cast("int")))
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("length").cast("int")))
    content = F.when(F.col("kind") == "zero", zeros).otherwise(cut)
    inside = F.col("length").isNull() | F.when(F.col("exact"), F.col("length") == size).otherwise(F.col("start") + F.col("length") <= size)
    ok = (F.col("kind") == "zero") | (size.isNotNull() & inside)
    return both.withColumn("content", content).withColumn("fetch_ok", F.coalesce(ok, F.lit(False))).drop("whole")


def _fold(algorithm: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows, h, size, parts = None, [], hashlib.new(algorithm), 0, 0
    started = False
    for b in batches:
        for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if started and key != now:
                rows.append((now, size, parts, f"{algorithm}={h.hexdigest()}"))
                h, size, parts = hashlib.new(algorithm), 0, 0
            now, started = key, True
            h.update(data or b"")
            size += len(data or b"")
            parts += 1
        if len(rows) > 10000:
            yield _rows(rows)
            rows = []
    if started:
        rows.append((now, size, parts, f"{algorithm}={h.hexdigest()}"))
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "size", "parts", "checksum"])


def content_digest(parts: DataFrame, file_col: str = "file", pos_col: str = "pos", content: str = "content", algorithm: str = "sha224") -> DataFrame:
    """``file, size, parts, checksum`` over each file's parts in order, hashed as they stream by: a file of any length needs the memory of one part."""
    rows = parts.select(F.col(file_col).cast("string").alias("file"), F.col(pos_col).alias("pos"), F.col(content).cast("binary").alias("content"))
    rows = rows.repartition("file").sortWithinPartitions("file", "pos").select("file", "content")
    return rows.mapInArrow(functools.partial(_fold, algorithm), "file string, size long, parts long, checksum string")


def verdicts(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Stored against rebuilt ``size`` and ``checksum`` per file: ``size_ok, checksum_ok``."""
    have = digests.select("file", F.col("size").alias("got_size"), F.col("checksum").alias("got_checksum"))
    both = files.join(have, "file", "left")
    return both.withColumn("size_ok", F.coalesce(F.col("size") == F.col("got_size"), F.lit(False))).withColumn("checksum_ok", F.coalesce(F.col("checksum") == F.col("got_checksum"), F.lit(False)))
