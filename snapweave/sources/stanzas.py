"""Metadata logs: stanzas of ``Key: value`` lines, with references to other logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.functions.codec import parse_device, parse_int, parse_user


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, as Catalyst repeats an expression wherever a higher-order function names it."""
    return F.transform(F.array(value), f)[0]


def _last(pairs: Column) -> Column:
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"])
    return F.when(F.size(F.array_distinct(pairs["key"])) == F.size(pairs), pairs).otherwise(F.filter(pairs, lambda p, i: ~later(p, i)))


def parse_stanza(text: Column) -> Column:
    """A stanza as a map. Lines that start with a blank continue the one before; the last of equal keys counts."""
    joined = F.replace(F.replace(F.btrim(text, F.lit("\n")), F.lit("\n "), F.lit(" ")), F.lit("\n\t"), F.lit("\t"))
    lines = F.filter(F.split(joined, "\n"), lambda x: x.contains(":"))
    parts = F.transform(lines, lambda x: F.split(x, ":", 2))
    pairs = F.transform(parts, lambda x: F.struct(x[0].alias("key"), F.ltrim(x[1], F.lit(" \t\n\x0b\f\r")).alias("value")))
    return _once(pairs, lambda p: F.map_from_entries(_last(p)))


def read_stanzas(spark: SparkSession, path: str) -> DataFrame:
    """``fields map<string,string>`` of each stanza in the text files at ``path``."""
    text = spark.read.option("lineSep", "\n\n").text(path)
    return text.where(F.trim(F.regexp_replace("value", r"\n", "")) != "").select(parse_stanza(F.col("value")).alias("fields"))


def descriptor(text: Column) -> Column:
    """A snapshot descriptor: its fields, scheme, root, segments and format version as numbers."""

    def read(f: Column) -> Column:
        version = F.transform(F.split(F.regexp_extract(f["Format"], r"v([0-9.]+)", 1), r"\."), lambda x: x.try_cast("int"))
        return F.struct(f.alias("fields"), f["Scheme"].alias("scheme"), f["Root"].alias("root"), F.split(F.trim(f["Segments"]), r"\s+").alias("segments"), version.alias("version"))

    return _once(parse_stanza(text), read)


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot descriptors, one per file."""
    return spark.read.option("wholetext", True).text(path).select(descriptor(F.col("value")).alias("d")).select("d.*")


def version_ok(version: Column, most: tuple[int, ...] = (0, 11)) -> Column:
    """Whether a format version isn't newer than ``most``; one that can't be read passes."""
    return F.coalesce(F.filter(version, lambda x: x.isNotNull()) <= F.array(*[F.lit(x) for x in most]), F.lit(True))


def statcache(text: Column) -> Column:
    """A cache entry: the ``@@`` reference of its first line, and its stanza."""
    return F.struct(F.regexp_extract(text, r"(?m)^@@(.*)$", 1).alias("ref"), parse_stanza(F.regexp_replace(text, r"(?m)^@@.*\n?", "")).alias("fields"))


def typed_items(stanzas: DataFrame) -> DataFrame:
    """Stanzas as typed file rows; keys that aren't known stay in ``fields``."""
    f = F.col("fields")
    return stanzas.select(
        F.coalesce(f["name"], f["path"]).alias("name"), f["type"].alias("type"), parse_int(f["mode"]).cast("int").alias("mode"),
        parse_user(f["user"]).alias("user"), parse_user(f["group"]).alias("group"), parse_int(f["ctime"]).alias("ctime"), parse_int(f["mtime"]).alias("mtime"),
        parse_int(f["links"]).cast("int").alias("links"), f["inode"].alias("inode"), parse_int(f["size"]).alias("size"), f["checksum"].alias("checksum"),
        f["target"].alias("target"), parse_device(f["device"]).alias("device"), F.coalesce(parse_int(f["volatile"]) == 1, F.lit(False)).alias("volatile"),
        F.filter(F.split(F.trim(f["data"]), r"\s+"), lambda x: x != "").alias("data"), "fields",
    )


def expand(lines: DataFrame, logs: DataFrame, depth: int = 3) -> DataFrame:
    """Replaces ``@ref`` lines by the lines of the log that they name, up to ``depth`` levels, in order.

    ``lines``: ``place array<int>, line``; ``logs``: ``ref, no, line``.
    """
    for _ in range(depth):
        ref = F.when(F.startswith("line", F.lit("@")) & ~F.startswith("line", F.lit("@@")), F.substring("line", 2, 1 << 20))
        named = logs.select(F.col("ref").alias("named"), F.col("no").alias("inner_no"), F.col("line").alias("inner"))
        joined = lines.withColumn("named", ref).join(named, "named", "left")
        lines = joined.select(F.when(F.col("inner").isNull(), F.col("place")).otherwise(F.concat("place", F.array("inner_no"))).alias("place"), F.coalesce("inner", "line").alias("line"))
    return lines


def format_stanza(fields: Column) -> Column:
    """A map as text: ``name`` first, then keys in the order of their bytes."""
    entries = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct((e["key"] != "name").cast("int").alias("o"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit(": "), e["v"])), "\n")
