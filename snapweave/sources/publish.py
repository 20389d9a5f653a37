"""Writing a snapshot's metadata log, its segments' metadata and, last of all, its descriptor."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapweave.functions.refs import format_ref
from snapweave.sources.stanzas import format_stanza

#: Bytes of stanzas beyond which a metadata object is closed.
LOG_OBJECT = 65536
#: Columns of a segment that its metadata may set, in the order in which they are written.
SEGMENT_FIELDS = {"checksum": "string", "data_size": "long", "timestamp": "timestamp_ntz", "disk_size": "long", "path": "string", "type": "string"}


def _logged(least: int, parted: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot and place: (slot, place, text, segment, object, start, length). Out: a row per item, and one per object (place null) with its content."""
    names = ["slot", "object_no", "place", "offset", "length", "content"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    slot, no, size, at, lines, pending, out = None, 0, 0, 0, [], None, []

    def say(text: str) -> None:
        nonlocal at
        lines.append(text)
        at += len(text.encode())

    def pointed(more: str = "") -> None:
        nonlocal pending
        if pending:
            say("@{}/{}[{}+{}]\n".format(*pending) + more)
            pending = None

    def closed() -> None:
        nonlocal no, size, at, lines
        pointed("\n" if parted and pending and pending[4] > 1 else "")
        if lines:
            out.append((slot, no, None, None, at, "".join(lines)))
            no += 1
        size, at, lines = 0, 0, []

    for b in batches:
        for new_slot, place, text, segment, obj, start, length in zip(*[c.to_pylist() for c in b.columns]):
            if new_slot != slot:
                closed()
                slot, no = new_slot, 0
            if segment is None:
                pointed("\n")
                out.append((slot, no, place, at, len(text.encode()), None))
                say(text)
            elif pending and pending[:2] == (segment, obj) and pending[2] + pending[3] == start:
                pending = (segment, obj, pending[2], pending[3] + length, pending[4] + 1)
            else:
                pointed()
                pending = (segment, obj, start, length, 1)
            size += len(text.encode())
            if size > least:
                closed()
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    closed()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def metadata_log(items: DataFrame, least: int = LOG_OBJECT, parted: bool = False) -> DataFrame:
    """Packs stanzas into metadata objects: ``slot, object_no, place, offset, length, content``.

    ``items``: ``slot, place, text`` (a stanza and its blank line) and ``reused``, null or the
    ``segment, object, start, length`` where the stanza already stands. Slots are written side by side,
    each in the order of ``place``. An object takes stanzas until they have more than ``least``
    bytes; reused ones become ``@`` references, neighbours merged, with a blank line before a new
    stanza. With ``parted``, a blank line also follows a reference to several stanzas that ends an
    object; readers skip it. Rows with a ``place`` say where a new stanza lies in its object; those
    without are the objects, with their ``content``.
    """
    r = F.col("reused")
    rows = items.select(F.col("slot").cast("long"), F.col("place").cast("long"), "text", *[r[c].cast("long" if c in ("start", "length") else "string").alias(c) for c in ("segment", "object", "start", "length")])
    rows = rows.repartition("slot").sortWithinPartitions("slot", "place")
    return rows.mapInArrow(functools.partial(_logged, least, parted), "slot long, object_no long, place long, offset long, length long, content string")


def statcache_entries(items: DataFrame, log: DataFrame, segment: Column, obj: Column) -> DataFrame:
    """``place, entry``: each stanza behind an ``@@`` line that says where it lies; ``segment`` and ``obj`` name a log object by its ``slot`` and ``object_no``."""
    new = log.where("place is not null").select("slot", "place", segment.alias("segment"), obj.alias("object"), F.col("offset").alias("start"), F.col("length").alias("size"))
    both = items.join(new, ["slot", "place"], "left")
    known = F.col("reused").isNotNull()
    ref = F.struct(
        F.lit("normal").alias("kind"), F.lit(False).alias("indirect"), F.when(known, F.col("reused.segment")).otherwise(F.col("segment")).alias("segment"),
        F.when(known, F.col("reused.object")).otherwise(F.col("object")).alias("object"), F.lit(None).cast("string").alias("checksum"),
        F.when(known, F.col("reused.start")).otherwise(F.col("start")).alias("start"), F.when(known, F.col("reused.length")).otherwise(F.col("size")).alias("length"), F.lit(False).alias("exact"),
    )
    return both.select("place", F.concat(F.lit("@@"), format_ref(ref), F.lit("\n"), "text").alias("entry"))


def closed_segments(built: DataFrame, segments: DataFrame, now: Column) -> DataFrame:
    """The segment table with what ``build_segments`` has closed (``segment, data_size, disk_size, checksum, path, type``); the time of a segment that is known already stays."""
    old = segments.select("segment", F.col("timestamp").alias("first_time"), F.lit(True).alias("known"))
    fresh = built.join(old, "segment", "left").withColumn("timestamp", F.coalesce("first_time", now))
    rest = segments.join(built.select("segment"), "segment", "left_anti")
    return rest.unionByName(fresh.select(*segments.columns))


def segment_metadata(segments: DataFrame) -> DataFrame:
    """``segment, stanza``: what is known of each segment, keys in the order of their bytes; the time is called ``datetime``."""
    said = {"segment": F.col("segment")} | {("datetime" if k == "timestamp" else k): (F.date_format(k, "yyyy-MM-dd HH:mm:ss") if k == "timestamp" else F.col(k).cast("string")) for k in SEGMENT_FIELDS}
    fields = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in said.items()]), lambda e: e["value"].isNotNull()))
    return segments.select("segment", format_stanza(fields).alias("stanza"))


def load_segment_metadata(segments: DataFrame, stanzas: DataFrame) -> DataFrame:
    """The segment table (``segment`` and ``SEGMENT_FIELDS``) updated from parsed stanzas (``fields``): unknown segments are added, fields that a stanza doesn't name stay, keys that are no columns are ignored."""
    f = F.col("fields")
    said = {k: (F.coalesce(f["timestamp"], f["datetime"]) if k == "timestamp" else f[k]).try_cast(t) for k, t in SEGMENT_FIELDS.items()}
    read = stanzas.select(F.explode(F.array("fields")).alias("fields"))  # filters stay behind it, so that no stanza is parsed for each
    rows = read.where(f["segment"].isNotNull()).groupBy(f["segment"].alias("segment")).agg(*[F.max(v).alias(f"new_{k}") for k, v in said.items()])
    both = segments.join(rows, "segment", "full")
    return both.select("segment", *[F.coalesce(f"new_{k}", k).alias(k) for k in SEGMENT_FIELDS])


def descriptor_lines(header: dict[str, str], segments: DataFrame) -> DataFrame:
    """``part, line`` of a snapshot descriptor: the header's lines in order, then the names of its segments, one a line. Sorted by both columns they make the file."""
    spark = segments.sparkSession
    head = [(i, f"{k}: {v}") for i, (k, v) in enumerate(header.items())] + [(len(header), "Segments:")]
    rows = segments.select(F.lit(len(head)).alias("part"), F.concat(F.lit("    "), "segment").alias("line")).distinct()
    return spark.createDataFrame(head, "part int, line string").unionByName(rows)


def publish(lines: DataFrame, path: str) -> None:
    """Writes a descriptor; the last step of a snapshot, as it makes the snapshot visible. Spark's committer renames the files into place once all are written, and an existing descriptor is never replaced."""
    lines.orderBy("part", "line").select("line").write.mode("error").text(path)
