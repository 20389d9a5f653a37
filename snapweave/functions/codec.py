"""Column builders for the text encodings of snapshot data."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

HASHES: dict[str, Callable[[Column], Column]] = {
    "sha1": F.sha1,
    "sha224": lambda c: F.sha2(c, 224),
    "sha256": lambda c: F.sha2(c, 256),
}


def register_hash(name: str, build: Callable[[Column], Column]) -> None:
    """Adds a hash algorithm: ``build`` turns a binary column into lower-case hex."""
    HASHES[name] = build


def checksum(data: Column, algorithm: str = "sha224") -> Column:
    """``name=hex`` of a binary column."""
    return F.concat(F.lit(f"{algorithm}="), HASHES[algorithm](data))


def checksum_ok(data: Column, text: Column) -> Column:
    """Whether ``name=hex`` fits the data; null for an algorithm that isn't registered."""
    out = F.lit(None).cast("boolean")
    for name, build in HASHES.items():
        out = F.when(F.startswith(text, F.lit(f"{name}=")), F.concat(F.lit(f"{name}="), build(data)) == F.lower(text)).otherwise(out)
    return out


def uri_encode(text: Column) -> Column:
    """Bytes 0x2B to 0x7E stay, but for ``@``; others become ``%xx``. Runs of either sort are taken whole."""
    runs = F.regexp_extract_all(text, F.lit(r"[+-?A-~]+|[^+-?A-~]+"), F.lit(0))
    escaped = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-8"))), "(..)", "%$1")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"\A[+-?A-~]"), x).otherwise(escaped(x))), "")


@pandas_udf(T.BinaryType())
def uri_decode(text: pd.Series) -> pd.Series:
    """Bytes behind ``%xx``; a malformed ``%`` stays. Binary, since names need not be UTF-8."""
    return text.map(lambda t: None if t is None else unquote_to_bytes(t))


def parse_int(text: Column) -> Column:
    """Decimal, ``0x`` hexadecimal or ``0`` octal, signed; null if it is none of these."""
    sign = F.when(F.startswith(text, F.lit("-")), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    body = F.regexp_replace(text, "^[+-]", "")
    in_base = lambda digits, base: F.conv(digits, base, 10).cast("long")
    value = (
        F.when(body.rlike(r"\A0[xX][0-9a-fA-F]+\z"), in_base(F.substring(body, 3, 32), 16))
        .when(body.rlike(r"\A0[0-7]+\z"), in_base(F.substring(body, 2, 32), 8))
        .when(body.rlike(r"\A[0-9]+\z"), body.try_cast("long"))
    )
    return sign * value


def encode_int(n: Column, base: int = 10) -> Column:
    """The inverse of ``parse_int``: prefixed by base for positive numbers."""
    if base == 10:
        return n.cast("string")
    digits = F.lower(F.conv(n.cast("string"), 10, base))
    return F.when(n > 0, F.concat(F.lit({8: "0", 16: "0x"}[base]), digits)).otherwise(n.cast("string"))


def parse_user(text: Column) -> Column:
    """``uid (name)`` as a struct; the name is null where there is none."""
    name = F.regexp_extract(text, r"\(([^)]*)\)", 1)
    return F.struct(parse_int(F.regexp_extract(text, r"^\s*(\S+)", 1)).alias("id"), F.nullif(name, F.lit("")).alias("name"))


def format_user(user: Column) -> Column:
    return F.concat(user["id"].cast("string"), F.when(user["name"].isNull(), "").otherwise(F.concat(F.lit(" ("), uri_encode(user["name"]), F.lit(")"))))


def parse_device(text: Column) -> Column:
    parts = F.split(text, "/")
    return F.struct(parse_int(F.get(parts, F.lit(0))).cast("int").alias("major"), parse_int(F.get(parts, F.lit(1))).cast("int").alias("minor"))


def snapshot_time(text: Column) -> Column:
    """``20240131T235959`` as a timestamp without zone."""
    return F.to_timestamp_ntz(text, F.lit("yyyyMMdd'T'HHmmss"))


def format_snapshot_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def split_snapshot_name(name: Column) -> Column:
    """``scheme-time``, split at the last hyphen."""
    return F.struct(F.regexp_extract(name, r"(?s)\A(.*)-(.*)\z", 1).alias("scheme"), snapshot_time(F.regexp_extract(name, r"(?s)\A(.*)-(.*)\z", 2)).alias("timestamp"))


def julian_day(ts: Column) -> Column:
    """Days since noon of 24 November 4714 BC; the session's zone should be UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400000000.0) + F.lit(2440587.5)


def normal_path(path: Column) -> Column:
    """One leading slash goes; the root is ``.``."""
    cut = F.regexp_replace(path, r"\A/", "")
    return F.when(cut == "", ".").otherwise(cut)


def object_name(n: Column) -> Column:
    """Eight hexadecimal digits."""
    return F.lower(F.lpad(F.hex(n), 8, "0"))


def mib(size: Column) -> Column:
    return F.round(size / F.lit(1048576.0), 3)


# Seconds of each unit of an interval.
UNITS = {"s": 1, "m": 60, "h": 3600, "D": 86400, "W": 7 * 86400, "M": 30 * 86400, "Y": 365 * 86400}


def interval_seconds(text: str) -> int:
    """Length of an interval such as ``1Y6M`` in seconds."""
    if not re.fullmatch(r"(\d+[smhDWMY])+", text):
        raise ValueError(f"not an interval: {text!r}")
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(.)", text))


def interval_column(text: Column) -> Column:
    """The same over a column; null where it isn't an interval."""
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[smhDWMY])"), F.lit(1))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + F.regexp_extract(p, r"\d+", 0).cast("long") * unit[F.right(p, F.lit(1))])
    return F.when(text.rlike(r"\A(\d+[smhDWMY])+\z"), total)
