"""Rebuilding a lost block index from metadata and the files that it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapweave.functions.codec import checksum, checksum_ok
from snapweave.operators.blocks import running_offsets
from snapweave.operators.chunks import SIGNATURE_LEAST, chunked


def signed(length: Column, incremental: Column, least: int = SIGNATURE_LEAST) -> Column:
    """Whether a block gets chunk signatures: it is large enough, or stored as changes to an old one."""
    return (length >= least) | incremental


def readable_slices(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``file, pos, segment, object, start, length, exact, data`` of the references (``kind`` zero left out) to files that are as their metadata say.

    ``refs``: ``file, pos, kind, segment, object, start, length, exact``; ``files``: ``file, content, checksum``
    (``name=hex``). A file is left alone if the length of one of its references isn't known, or
    if its bytes don't have the checksum any more.
    """
    sizes = refs.groupBy("file").agg(F.sum("length").alias("total"), F.count_if(F.col("length").isNull()).alias("unknown")).where("unknown = 0").drop("unknown")
    same = files.join(sizes, "file").where(checksum_ok(F.substring(F.col("content").cast("binary"), F.lit(1), F.col("total").cast("int")), F.col("checksum")))
    at = running_offsets(refs, "file", "pos").where(F.col("kind") != "zero")
    data = F.substring(F.col("content").cast("binary"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return at.join(same.select("file", "content"), "file").select("file", "pos", "segment", "object", "start", "length", "exact", data.alias("data"))


def rebuilt_objects(slices: DataFrame, algorithm: str = "sha224") -> DataFrame:
    """``segment, object, checksum, size``: the checksum where a slice is all of the object, and the most that its size is known to be at least."""
    whole = F.when(F.col("exact"), checksum(F.col("data"), algorithm))
    reach = F.when(F.col("exact"), F.col("length")).otherwise(F.col("start") + F.col("length"))
    return slices.groupBy("segment", "object").agg(F.max(whole).alias("checksum"), F.max(reach).alias("size"))


def rebuilt_signatures(slices: DataFrame, algorithm: str = "sha224", least: int = SIGNATURE_LEAST) -> DataFrame:
    """``segment, object, offset, length, hash`` of the chunks of slices that are large or only a part of their object, once each."""
    rows = slices.where(signed(F.col("length"), ~F.col("exact"), least))
    parts = chunked(rows, ("segment", "object", "start"), "data", algorithm)
    return parts.select("segment", "object", (F.col("start") + F.col("offset")).alias("offset"), "length", "hash").distinct()


def with_rebuilt(index: DataFrame, objects: DataFrame) -> DataFrame:
    """A block index (``segment, object, checksum, size``) with rebuilt objects: missing ones are added, a checksum is never lost, sizes only grow."""
    new = objects.select("segment", "object", F.col("checksum").alias("new_checksum"), F.col("size").alias("new_size"))
    both = index.join(new, ["segment", "object"], "full")
    size = F.greatest(F.coalesce("new_size", F.lit(0)), F.coalesce("size", F.lit(0)))
    return both.withColumns({"checksum": F.coalesce("new_checksum", "checksum"), "size": F.when(F.coalesce("new_size", "size").isNotNull(), size)}).drop("new_checksum", "new_size")


def object_signatures(asked: DataFrame, index: DataFrame, signatures: DataFrame) -> DataFrame:
    """``algorithm, signatures`` of objects (``segmentid, object``), by the id of their block; objects without any give no row."""
    ids = index.select("segmentid", "object", "blockid")
    return asked.join(ids, ["segmentid", "object"]).join(signatures, "blockid")
