"""Configuration of schemes, and the files of a store by what they are."""

from __future__ import annotations

import configparser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapweave.functions.codec import interval_seconds

_SCHEME = "backup:"
# Names of the files in a store by type, and the folders in which each type is looked for; the first group is the object's name.
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
TYPES = {
    "checksums": (r"\Asnapshot-(.*)\.(\w+)sums\z", ("meta", "checksums", "")),
    "meta": (r"\Asnapshot-(.*)\.meta(\.\S+)?\z", ("meta",)),
    "segments": (rf"\A({_UUID})\.tar(\.\S+)?\z", ("segments0", "segments1", "", "segments")),
    "snapshots": (r"\Asnapshot-(.*)\.(?!meta|\w+sums)(\w+)\z", ("snapshots", "")),
}


def retention_policy(text: str) -> tuple[dict[str, int], list[str]]:
    """Seconds by class from ``class:interval`` words, and the words that are none."""
    policy, odd = {}, []
    for word in text.split():
        name, _, interval = word.partition(":")
        try:
            policy[name] = interval_seconds(interval)
        except ValueError:
            odd.append(word)
    return policy, odd


def read_config(text: str) -> dict[str, dict[str, str]]:
    """Options by scheme, from the sections ``backup:<scheme>``; other sections are kept under their own names in brackets."""
    parser = configparser.RawConfigParser()
    parser.read_string(text)
    return {(s.removeprefix(_SCHEME) if s.startswith(_SCHEME) else f"[{s}]"): dict(parser.items(s)) for s in parser.sections()}


def is_segment_name(name: Column) -> Column:
    return name.rlike(rf"\A{_UUID}\z")


def typed_listing(files: DataFrame, path: str = "path") -> DataFrame:
    """``type, name, extension`` of the listed files that a store's types know, in the folders where they are looked for; a file is of one type only, others are left out."""
    folder = F.regexp_extract(path, r"(?s)\A(?:(.*)/)?[^/]*\z", 1)
    base = F.regexp_extract(path, r"(?s)([^/]*)\z", 1)
    out = F.lit(None).cast("struct<type:string,name:string,extension:string>")
    for kind, (pattern, folders) in TYPES.items():
        hit = base.rlike(pattern) & folder.isin(*folders)
        out = F.when(hit, F.struct(F.lit(kind).alias("type"), F.regexp_extract(base, pattern, 1).alias("name"), F.ltrim(F.regexp_extract(base, pattern, 2), F.lit(".")).alias("extension"))).otherwise(out)
    return files.withColumn("typed_", out).where("typed_ is not null").select(*files.columns, "typed_.*")
