"""Splitting contents into blocks, and deciding which of them to store."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapweave.functions.codec import checksum

BLOCK = 1 << 20


def split_blocks(files: DataFrame, size: int = BLOCK, content: str = "content") -> DataFrame:
    """One row per block of ``size`` characters (strings) or bytes (binaries): ``pos, block, block_size``; empty contents have none."""
    length = F.length(content)
    starts = F.when(length > 0, F.sequence(F.lit(0), F.floor((length - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    others = [c for c in files.columns if c != content]
    rows = files.select(*others, content, F.explode(starts).alias("pos"))
    return rows.select(*others, "pos", F.substring(F.col(content), F.col("pos") * size + 1, F.lit(size)).alias("block")).withColumn("block_size", F.length("block").cast("long"))


def is_zero(block: Column) -> Column:
    """Whether a binary holds only zero bytes (and at least one)."""
    return (F.length(block) > 0) & (F.length(F.ltrim(block.cast("string"), F.lit("\0"))) == 0)


def dedup_report(blocks: DataFrame, key: str = "checksum", size: str = "block_size", owner: str = "doc_id") -> DataFrame:
    """Per distinct block: references, first owner, and logical against stored bytes."""
    return blocks.groupBy(key, size).agg(F.count("*").alias("refs"), F.min(owner).alias("first_owner"), F.sum(size).alias("logical_bytes")).withColumn("stored_bytes", F.col(size))


def first_owner(blocks: DataFrame, order: tuple[str, ...], key: str = "checksum", size: str = "block_size") -> DataFrame:
    """Marks the first row of each distinct block (in ``order``) as ``is_new``.

    The least position is combined before the shuffle, and only of blocks that stand more than
    once joined back. The rows of one block still meet where that join is by shuffle; its other side
    has one row a block, so AQE can split them.
    """
    at = F.struct(*order)
    first = blocks.groupBy(key, size).agg(F.min(at).alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return blocks.join(first, [key, size], "left").withColumn("is_new", F.coalesce(at == F.col("first"), F.lit(True))).drop("first")


def known_objects(index: DataFrame) -> DataFrame:
    """Of each content in a block index: the object of the least block id that isn't expired (``live``), and the expired one of the least block id with its age and group (``old``)."""
    expired = F.col("expired").isNotNull()
    live = F.min_by(F.struct("segmentid", "object", "blockid"), F.when(~expired, F.col("blockid"))).alias("live")
    old = F.min_by(F.struct("segmentid", "object", "timestamp", "expired"), F.when(expired, F.col("blockid"))).alias("old")
    return index.groupBy("checksum", "size").agg(live, old)


def decide(blocks: DataFrame, index: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """What to do with each block: ``decision`` zero, reuse, rewrite, new or repeat, and the ``group`` that its data is written to.

    Zero blocks are never stored. A live object with the same content is reused; an expired one is
    written again, into the group of its age; otherwise the first of equal blocks in this run is
    new and the others repeat it.
    """
    marked = first_owner(blocks, order)
    known = marked.join(known_objects(index).withColumnRenamed("size", "block_size"), ["checksum", "block_size"], "left")
    decision = F.when(F.col("zero"), "zero").when(F.col("live").isNotNull(), "reuse").when(~F.col("is_new"), "repeat").when(F.col("old").isNotNull(), "rewrite").otherwise("new")
    group = F.when(F.col("old.expired") > 0, F.concat(F.lit("compacted-"), F.col("old.expired"))).otherwise(F.lit("data"))
    return known.withColumn("decision", decision).withColumn("group", F.when(F.col("decision").isin("rewrite", "new"), group))


def file_status(decided: DataFrame, file_col: str, cached: str | None = None) -> DataFrame:
    """Status per file: ``new`` if a block is new, else ``partial`` if one is rewritten or cut, else ``repack`` where its metadata was unchanged, else ``old``."""
    fresh = F.max(F.col("decision").isin("new").cast("int")) == 1
    part = F.max(F.col("decision").isin("rewrite", "incremental").cast("int")) == 1
    again = (F.max(F.col(cached).cast("int")) == 1) if cached else F.lit(False)
    return decided.groupBy(file_col).agg(F.when(fresh, "new").when(again, "repack").when(part, "partial").otherwise("old").alias("status"), F.count("*").alias("blocks"))


def with_checksum(blocks: DataFrame, algorithm: str = "sha224", block: str = "block") -> DataFrame:
    return blocks.withColumn("checksum", checksum(F.col(block).cast("binary"), algorithm))


def object_available(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``available``: references to anything but a stored object always are, others if the object isn't expired."""
    live = index.where(F.col("expired").isNull()).select("segmentid", "object").distinct().withColumn("live", F.lit(True))
    return refs.join(live, ["segmentid", "object"], "left").withColumn("available", (F.col("kind") != "normal") | F.col("live").isNotNull()).drop("live")


def _packed(target: int, groups: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, slot and order; the last column is the size. Adds the numbers of the segment and in it."""
    now, seg, no, filled = None, 0, 0, 0
    for b in batches:
        segs, nos = [], []
        for *key, size in zip(*[b.column(i).to_pylist() for i in [*range(groups), b.num_columns - 1]]):
            if key != now:
                now, seg, no, filled = key, 0, 0, 0
            elif filled >= target:
                seg, no, filled = seg + 1, 0, 0
            segs.append(seg)
            nos.append(no)
            filled, no = filled + (size or 0), no + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segs, pa.int64()), pa.array(nos, pa.int64())], names=[*b.schema.names, "segment_no", "object_no"])


def pack_segments(objects: DataFrame, target: int = 4 << 20, group: str = "group", order: tuple[str, ...] = ("object_order",), size: str = "size", slots: int = 64) -> DataFrame:
    """Deals objects to segments per group: ``slot, segment_no, object_no``.

    A segment takes objects in order until it holds ``target`` bytes or more. Groups are
    folded in ``slots`` independent streams (by hash of the order, kept in order inside), as
    that many writers would fill segments side by side; with one slot the result is the
    sequential one. A stream is sorted and passes by; none is held.
    """
    slot = F.pmod(F.xxhash64(*order), F.lit(slots)).cast("int") if slots > 1 else F.lit(0)
    keys = [F.col(group).alias("g"), slot.alias("slot"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]]
    rows = objects.select(*keys, F.col(size).cast("long").alias("bytes")).repartition("g", "slot").sortWithinPartitions("g", "slot", *[f"o{i}" for i in range(len(order))])
    schema = T.StructType([*rows.schema.fields, T.StructField("segment_no", T.LongType()), T.StructField("object_no", T.LongType())])
    placed = rows.mapInArrow(functools.partial(_packed, target, 2), schema)
    return placed.select(F.col("g").alias(group), "slot", *[F.col(f"o{i}").alias(o) for i, o in enumerate(order)], F.col("bytes").alias(size), "segment_no", "object_no")


def coalesce_refs(refs: DataFrame, file_col: str, pos_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Merges neighbouring slices of one object: ``first_pos, segment, object, start, length, parts`` per run.

    Slices merge if they follow each other in the file, name one object (and checksum), say no
    exact length, and the second starts where the first ends. Columns ``carried`` have one value a file.
    """
    w = Window.partitionBy(file_col).orderBy(pos_col)
    prev = lambda c: F.lag(c).over(w)
    joins = (prev("segment") == F.col("segment")) & (prev("object") == F.col("object")) & prev("checksum").eqNullSafe(F.col("checksum")) & (prev("start") + prev("length") == F.col("start")) & ~F.col("exact") & ~prev("exact")
    runs = refs.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    return runs.groupBy(file_col, "run").agg(F.min(pos_col).alias("first_pos"), F.first("segment").alias("segment"), F.first("object").alias("object"), F.min("start").alias("start"), F.sum("length").alias("length"), F.count("*").alias("parts"), *[F.first(c).alias(c) for c in carried])


def running_offsets(parts: DataFrame, file_col: str, pos_col: str, length_col: str = "length") -> DataFrame:
    """Adds ``offset``: the sum of the lengths before."""
    w = Window.partitionBy(file_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(length_col).over(w), F.lit(0)))


def byte_range(parts: DataFrame, file_col: str, pos_col: str, start: int, size: int, content: str = "content") -> DataFrame:
    """The bytes ``[start, start + size)`` of each file, as slices of its parts in order."""
    at = running_offsets(parts.withColumn("length", F.length(content)), file_col, pos_col)
    lo = F.greatest(F.lit(start) - F.col("offset"), F.lit(0))
    hi = F.least(F.lit(start + size) - F.col("offset"), F.col("length"))
    return at.where(hi > lo).select(file_col, pos_col, F.substring(F.col(content), lo.cast("int") + 1, (hi - lo).cast("int")).alias("slice"))


def is_regular(kind: Column) -> Column:
    """Whether a file type is that of a regular file, in its present or its older spelling."""
    return kind.isin("f", "-")


def volatile(changed: Column, scanned: Column, is_directory: Column, grew: Column, seconds: int = 30) -> Column:
    """Whether a file may still be changing: not a directory and touched within ``seconds`` before the scan, or of another size once read."""
    return (~is_directory & (scanned - changed < seconds)) | F.coalesce(grew, F.lit(False))


def reuse_stanzas(now: DataFrame, before: DataFrame, available: DataFrame, path: str = "path", stanza: str = "stanza", ref: str = "ref") -> DataFrame:
    """Rows of a new log with ``reused``: the old reference of an identical stanza whose object is available, else null."""
    old = before.join(available.select(ref), ref, "left_semi").select(path, F.sha2(F.col(stanza), 256).alias("digest"), F.col(ref).alias("reused"))
    old = old.groupBy(path, "digest").agg(F.min("reused").alias("reused"))
    return now.withColumn("digest", F.sha2(F.col(stanza), 256)).join(old, [path, "digest"], "left").drop("digest")


def corrupted(scan: DataFrame, path: str = "path") -> DataFrame:
    """Files that are unchanged by their stat fields, but whose checksum is another."""
    return scan.where((F.col("state") == "unchanged") & (F.col("checksum") != F.col("old_checksum"))).select(path, "checksum", "old_checksum")


def least_sizes(refs: DataFrame, known: DataFrame | None = None, keys: tuple[str, ...] = ("segmentid", "object")) -> DataFrame:
    """A lower bound of each object's size: the furthest byte that a slice reaches, and what is known of it."""
    reach = refs.groupBy(*keys).agg(F.max(F.col("start") + F.col("length")).alias("size"))
    if known is None:
        return reach
    both = known.select(*keys, F.col("size").alias("known")).join(reach, list(keys), "full")
    return both.select(*keys, F.greatest(F.coalesce("size", F.lit(0)), F.coalesce("known", F.lit(0))).alias("size"))


def under_path(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the prefixes or below it; no prefixes let all pass."""
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | (path == p) | F.startswith(path, F.lit(f"{p.rstrip('/')}/"))
    return out


def listing(files: DataFrame, directory: str, path: str = "path") -> DataFrame:
    """What lies directly in a directory ("" is the root)."""
    depth = len(directory.split("/")) + 1 if directory else 1
    return files.where(under_path(F.col(path), [directory] if directory else []) & (F.size(F.split(path, "/")) == depth))
