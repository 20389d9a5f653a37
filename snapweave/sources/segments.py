"""Segments as tar files, one row per object."""

from __future__ import annotations

import functools
import hashlib
import io
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            segment = path.rsplit("/", 1)[-1].split(".")[0]
            rows = []
            with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                for m in tar:
                    if m.isfile():
                        rows.append((segment, m.name.rsplit("/", 1)[-1], m.size, tar.extractfile(m).read()))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["segment", "object", "size", "content"])


def members(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``segment, object, size, content`` of tar files (plain, gzip, bzip2 or xz) in a binary column; a segment is a few megabytes."""
    return archives.select(path, content).mapInArrow(_members, "segment string, object string, size long, content binary")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``members`` of the tar files at ``path``."""
    return members(spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").load(path))


def _tarred(mode: str, pdf):
    import pandas as pd

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in sorted(zip(pdf["object"], pdf["content"])):
            info = tarfile.TarInfo(f"{pdf['segment'].iloc[0]}/{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(bytes(data)))
    data = out.getvalue()
    return pd.DataFrame([(pdf["segment"].iloc[0], len(pdf), sum(map(len, pdf["content"])), len(data), "sha224=" + hashlib.sha224(data).hexdigest(), data)], columns=["segment", "objects", "data_size", "disk_size", "checksum", "archive"])


def build_segments(objects: DataFrame, compression: str = "bz2") -> DataFrame:
    """One tar archive per segment from ``segment, object, content``: ``segment, objects, data_size, disk_size, checksum, archive``. Packing has bounded a segment's size."""
    run = functools.partial(_tarred, f"w:{compression}" if compression else "w")
    return objects.select("segment", "object", "content").groupBy("segment").applyInPandas(run, "segment string, objects long, data_size long, disk_size long, checksum string, archive binary")


def segment_stats(objects: DataFrame) -> DataFrame:
    return objects.groupBy("segment").agg(F.count("*").alias("objects"), F.sum("size").alias("data_size"))
