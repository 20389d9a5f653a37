"""Content-defined chunks, and storing a changed block as what is new in it."""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapweave.operators.blocks import coalesce_refs

# They decide where chunks end, so equal data needs equal ones.
MODULUS = 0xBFE6B8A5BF378D83
WINDOW = 48
MARK = 0x78
LEAST, TARGET, MOST = 2048, 4096, 65535
#: Places whose fingerprints are taken at once.
SPAN = 4096
#: Blocks below this size get no signatures unless stored incrementally (``rebuild.signed``).
SIGNATURE_LEAST = 16384


@functools.cache
def _tables() -> np.ndarray:
    """What byte ``b``, ``k`` bytes back in the window, adds to the fingerprint's low bits."""
    out = np.zeros((WINDOW, 256), np.uint16)
    for b in range(256):
        x = b
        for k in range(WINDOW):
            out[k, b] = x & (TARGET - 1)
            for _ in range(8):
                x <<= 1
                if x >> 63:
                    x ^= MODULUS
    return out


def _mark(arr: np.ndarray, first: int, last: int) -> int:
    """The first place from ``first`` on, below ``last``, behind which the fingerprint marks a border, or ``last``. The fingerprint is linear, so it is the exclusive or of table rows, for a span of places at once."""
    for a in range(first, last, SPAN):
        b = min(a + SPAN, last)
        low = max(a - WINDOW + 1, 0)
        near = arr[low:b].astype(np.intp)
        prints = np.zeros(b - a, np.uint16)
        for k, table in enumerate(_tables()):
            skip = max(k - (a - low), 0)  # places that have fewer bytes before them
            if skip < b - a:
                prints[skip:] ^= table.take(near[a - low + skip - k : b - low - k])
        hit = np.flatnonzero(prints == MARK)
        if len(hit):
            return a + int(hit[0])
    return last


def breaks(data: bytes) -> list[int]:
    """Chunk borders, 0 first and the length last. Only places where a chunk may end are looked at."""
    arr = np.frombuffer(data, np.uint8)
    out = [0]
    while out[-1] < len(arr):
        last = min(out[-1] + MOST, len(arr)) - 1
        out.append(_mark(arr, min(out[-1] + LEAST - 1, last), last) + 1)
    return out


def _chunked(algorithm: str, carried: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = [*[f"c{c}" for c in range(carried)], "chunk_no", "offset", "length", "hash"]
    for b in batches:
        rows, of = [], []
        for i in range(b.num_rows):
            data = b.column(carried)[i].as_py() or b""
            ends = breaks(data)
            rows += [(n, s, e - s, hashlib.new(algorithm, data[s:e]).digest()) for n, (s, e) in enumerate(zip(ends, ends[1:]))]
            of += [i] * (len(ends) - 1)
        at = pa.array(of, pa.int32())
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in range(carried)], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)


def chunked(blocks: DataFrame, keys: tuple[str, ...], content: str = "block", algorithm: str = "sha224") -> DataFrame:
    """The ``keys`` columns and ``chunk_no, offset, length, hash`` of every chunk; empty or null contents have none."""
    types = ", ".join(f"c{i} {blocks.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    rows = blocks.select(*keys, F.col(content).cast("binary"))
    out = rows.mapInArrow(functools.partial(_chunked, algorithm, len(keys)), f"{types}, chunk_no int, offset long, length long, hash binary")
    return out.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keys)], "chunk_no", "offset", "length", "hash")


def pack_signatures(parts: list[tuple[int, bytes]]) -> bytes:
    """(length, digest) pairs as big-endian 16-bit lengths and digests, one after the other."""
    return b"".join(struct.pack(">H", n) + d for n, d in parts)


def unpack_signatures(blob: bytes, digest: int = 28) -> list[tuple[int, int, bytes | None]]:
    """(offset, length, digest) of each part; a digest of zeros marks a gap."""
    out, offset = [], 0
    for at in range(0, len(blob), 2 + digest):
        (n,) = struct.unpack_from(">H", blob, at)
        d = blob[at + 2 : at + 2 + digest]
        out.append((offset, n, d if any(d) else None))
        offset += n
    return out


def matched(new: DataFrame, old: DataFrame, file_col: str = "file") -> DataFrame:
    """Chunks of new blocks with the old chunk of the same file and hash: ``old_object, old_offset`` (null without one). Of several, the last in the order of (object, chunk number) counts."""
    index = old.groupBy(file_col, "hash").agg(F.max_by(F.struct("segment", "object", "offset"), F.struct("segment", "object", "chunk_no")).alias("old"))
    return new.join(index, [file_col, "hash"], "left")


def incremental(chunks: DataFrame, block: tuple[str, ...] = ("file", "pos")) -> DataFrame:
    """References that rebuild each new block: runs of old slices, and runs of the block's new object that holds all unmatched bytes.

    ``chunks`` is the result of ``matched``. ``kind`` is whole where nothing matches: the block is then stored as it is.
    """
    w = Window.partitionBy(*block).orderBy("chunk_no")
    own = F.when(F.col("old").isNull(), F.col("length")).otherwise(0)
    at = chunks.withColumn("start_new", F.coalesce(F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hits = F.sum(F.when(F.col("old").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(*block))
    refs = at.withColumn("hits", hits).select(
        *block, "chunk_no", "length", F.lit(False).alias("exact"), F.lit(None).cast("string").alias("checksum"), "hits",
        F.coalesce("old.segment", F.lit("new")).alias("segment"), F.coalesce("old.object", F.concat_ws("/", *[F.col(b).cast("string") for b in block])).alias("object"),
        F.when(F.col("old").isNull(), F.col("start_new")).otherwise(F.col("old.offset")).alias("start"),
    )
    key = F.concat_ws("\0", *[F.col(b).cast("string") for b in block])
    runs = coalesce_refs(refs.withColumn("block_key", key), "block_key", "chunk_no", carried=(*block, "hits"))
    kind = F.when(F.col("hits") == 0, "whole").when(F.col("segment") == "new", "new").otherwise("old")
    return runs.select(*block, "first_pos", kind.alias("kind"), "segment", "object", "start", "length", "parts")
