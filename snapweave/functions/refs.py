"""Object references: ``segment/object(checksum)[start+length]`` and its short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = r"\A(@?)(?:(zero)|([0-9a-f-]*)/([0-9a-f]*))(?:\(([^)]*)\))?(?:\[(?:(=?)([0-9]+)|([0-9]+)\+([0-9]+))\])?\z"


def parse_ref(text: Column) -> Column:
    """``kind`` (normal, zero or null), ``indirect, segment, object, checksum, start, length, exact``.

    ``[n]`` and the older ``[=n]`` say that the object has exactly n bytes, ``[a+n]`` takes n
    bytes from a on; what isn't a reference is of kind null.
    """
    # one pass of the pattern: its groups, parted by a character that no reference has
    fields = F.split(F.regexp_replace(text, _OBJECT, "\x01" + "\x01".join(f"${i}" for i in range(1, 10))), "\x01")
    part = lambda i: F.get(fields, F.lit(i))
    some = lambda i: F.nullif(part(i), F.lit(""))
    ok = F.coalesce((F.size(fields) == 10) & (part(0) == "") & ~text.contains("\x01"), F.lit(False))
    zero = part(2) == "zero"
    whole = some(7).try_cast("long")
    return F.struct(
        F.when(~ok | text.isNull(), "null").when(zero, "zero").otherwise("normal").alias("kind"),
        (ok & (part(1) == "@")).alias("indirect"),
        F.when(ok & ~zero, part(3)).alias("segment"),
        F.when(ok & ~zero, part(4)).alias("object"),
        F.when(ok, some(5)).alias("checksum"),
        F.when(ok, F.coalesce(some(8).try_cast("long"), F.when(whole.isNotNull(), F.lit(0).cast("long")))).alias("start"),
        F.when(ok, F.coalesce(some(9).try_cast("long"), whole)).alias("length"),
        (ok & whole.isNotNull()).alias("exact"),
    )


def format_ref(ref: Column) -> Column:
    """Text of a parsed reference."""
    body = F.when(ref["kind"] == "zero", "zero").otherwise(F.concat(ref["segment"], F.lit("/"), ref["object"], F.when(ref["checksum"].isNull(), "").otherwise(F.concat(F.lit("("), ref["checksum"], F.lit(")")))))
    short = ref["exact"] | (ref["kind"] == "zero")
    cut = F.when(ref["length"].isNull(), "").when(short, F.concat(F.lit("["), ref["length"], F.lit("]"))).otherwise(F.concat(F.lit("["), ref["start"], F.lit("+"), ref["length"], F.lit("]")))
    return F.when(ref["kind"] == "null", "null").otherwise(F.concat(F.when(ref["indirect"], "@").otherwise(""), body, cut))


def base_ref(ref: Column) -> Column:
    """The object itself, without checksum and range."""
    return F.struct(ref["segment"].alias("segment"), ref["object"].alias("object"))
