"""The catalog's tables: their schemas, versions that are published as a whole, and steps from older schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = (0, 11)
# The tables of this version of the schema, and their keys.
SCHEMAS = {
    "schema_version": "version string, major int, minor int",
    "snapshots": "snapshotid long, name string, scheme string, timestamp timestamp_ntz",
    "segments": "segmentid long, segment string, timestamp timestamp_ntz, path string, checksum string, data_size long, disk_size long, type string",
    "block_index": "blockid long, segmentid long, object string, checksum string, size long, timestamp timestamp_ntz, expired int",
    "subblock_signatures": "blockid long, algorithm string, signatures binary",
    "segment_utilization": "snapshotid long, segmentid long, bytes_referenced long",
}
KEYS = {"snapshots": ["snapshotid"], "segments": ["segmentid"], "block_index": ["segmentid", "object"], "subblock_signatures": ["blockid"], "segment_utilization": ["snapshotid", "segmentid"]}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """A new catalog: all tables without rows, but for the version."""
    tables = {name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()}
    return tables | {"schema_version": spark.createDataFrame([(".".join(map(str, VERSION)), *VERSION)], SCHEMAS["schema_version"])}


def publish(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Writes all tables as version ``version`` of the catalog at ``path``, and then the row that publishes it; without that row nobody reads it, so a failed run leaves no trace."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "number long").write.mode("append").parquet(f"{path}/published")


def open_catalog(spark: SparkSession, path: str, most: tuple[int, int] = VERSION) -> tuple[int, dict[str, DataFrame]]:
    """The number and the tables of the version published last; a schema that isn't ``most`` is an error."""
    number = spark.read.schema("number long").parquet(f"{path}/published").agg(F.max("number")).first()[0]
    tables = {name: spark.read.schema(ddl).parquet(f"{path}/version={number}/{name}") for name, ddl in SCHEMAS.items()}
    found = tables["schema_version"].select("major", "minor").first()
    if found is None or tuple(found) != most:
        raise ValueError(f"the catalog has schema {found and '.'.join(map(str, found))}, not {'.'.join(map(str, most))}")
    return number, tables


def used_fractions(contents: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """``snapshotid, segmentid, utilization``: the part of each segment's bytes that a snapshot's blocks (``snapshotid, blockid``) are."""
    used = contents.join(blocks, "blockid").groupBy("snapshotid", "segmentid").agg(F.sum("size").alias("used"))
    return used.join(segments.select("segmentid", "size"), "segmentid").select("snapshotid", "segmentid", (F.col("used").cast("double") / F.col("size")).alias("utilization"))


def with_sizes(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The oldest schema (``snapshot_contents``) with sizes and times of segments, use per snapshot, and an intent of 1 for snapshots."""
    sizes = tables["block_index"].groupBy("segmentid").agg(F.sum("size").alias("size"), F.max("timestamp").alias("mtime"))
    segments = tables["segments"].join(sizes, "segmentid", "left").withColumn("expire_time", F.lit(None).cast("long"))
    used = used_fractions(tables["snapshot_contents"], tables["block_index"].select("blockid", "segmentid", "size"), segments)
    rest = {k: v for k, v in tables.items() if k != "snapshot_contents"}
    return rest | {"segments": segments, "segments_used": used, "snapshots": tables["snapshots"].withColumn("intent", F.lit(1.0))}


def with_signatures(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The next schema: a snapshot without a scheme has the empty one, and there is a table of signatures."""
    spark = tables["snapshots"].sparkSession
    named = tables["snapshots"].withColumn("scheme", F.coalesce("scheme", F.lit("")))
    return tables | {"snapshots": named, "subblock_signatures": spark.createDataFrame([], SCHEMAS["subblock_signatures"])}


def to_current(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The schema of ``VERSION``: bytes in place of fractions of use, ``data_size`` in place of ``size``, columns that are gone left out and new ones null."""
    spark = tables["snapshots"].sparkSession
    sizes = tables["segments"].select("segmentid", "size")
    used = tables["segments_used"].join(sizes, "segmentid").withColumn("bytes_referenced", F.round(F.col("utilization") * F.col("size")).cast("long"))
    renamed = tables["segments"].withColumnsRenamed({"size": "data_size", "mtime": "timestamp"})
    found = tables | {"segments": renamed, "segment_utilization": used, "schema_version": empty(spark)["schema_version"]}
    out = {}
    for name, ddl in SCHEMAS.items():
        df, fields = found[name], spark.createDataFrame([], ddl).schema
        out[name] = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return out


def per_scheme(snapshots: DataFrame) -> DataFrame:
    """``scheme, snapshots``: the names of each scheme's snapshots in order. A scheme has a snapshot a run, so a row stays small."""
    return snapshots.groupBy("scheme").agg(F.sort_array(F.collect_list("name")).alias("snapshots"))
