"""Retention: which snapshots a policy keeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Class name to the part of time that it labels once; add to it for other classes.
CLASSES: dict[str, Callable[[Column], Column]] = {
    "yearly": lambda ts: F.date_trunc("year", ts),
    "monthly": lambda ts: F.date_trunc("month", ts),
    "weekly": lambda ts: F.date_trunc("week", ts),
    "daily": lambda ts: F.date_trunc("day", ts),
    "all": lambda ts: ts.cast("timestamp"),
}


def add_backup_class(name: str, part: Callable[[Column], Column]) -> None:
    CLASSES[name] = part


def labels(snapshots: DataFrame, policy: dict[str, int], now: Column, zone: str = "UTC") -> DataFrame:
    """One row per label: ``scheme, class, snapshotid, timestamp, retained``.

    The earliest snapshot of each part of a class gets its label; it is retained while its age is
    less than the class's period in seconds. The earliest is found by an aggregate, combined
    before the shuffle.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("timestamp"))
    parts = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(p).cast("long").alias("period"), CLASSES[c](local).cast("timestamp_ntz").alias("part")) for c, p in policy.items()])
    each = snapshots.select("scheme", "snapshotid", "timestamp", F.explode(parts).alias("k")).select("scheme", "snapshotid", "timestamp", "k.*")
    first = each.groupBy("scheme", "class", "period", "part").agg(F.min(F.struct("timestamp", "snapshotid")).alias("s"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("s.timestamp").cast("timestamp"))) / F.lit(1e6)
    return first.select("scheme", "class", F.col("s.snapshotid").alias("snapshotid"), F.col("s.timestamp").alias("timestamp"), (age < F.col("period")).alias("retained"))


def retained(snapshots: DataFrame, labelled: DataFrame) -> DataFrame:
    """Snapshots with ``retained``: whether any of their labels is."""
    hit = labelled.where("retained").select("snapshotid").distinct().withColumn("retained", F.lit(True))
    return snapshots.join(hit, "snapshotid", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))


def last_labelled(labelled: DataFrame) -> DataFrame:
    """The last label of each class, if it is retained (the last one is picked first)."""
    last = labelled.groupBy("scheme", "class").agg(F.max_by(F.struct("snapshotid", "timestamp", "retained"), F.struct("timestamp", "snapshotid")).alias("s"))
    return last.where("s.retained").select("scheme", "class", "s.snapshotid", "s.timestamp")


def evict(snapshots: DataFrame, labelled: DataFrame) -> DataFrame:
    """Snapshots that may go: neither the last of a class nor the newest of their scheme."""
    newest = snapshots.groupBy("scheme").agg(F.max_by("snapshotid", F.struct("timestamp", "snapshotid")).alias("snapshotid")).select("snapshotid")
    keep = last_labelled(labelled).select("snapshotid").union(newest)
    return snapshots.join(keep, "snapshotid", "left_anti")


def expired_names(snapshots: DataFrame, labelled: DataFrame, keep: str = "newest") -> DataFrame:
    """Snapshots that no label retains. ``newest`` spares the newest of all of a scheme, ``newest_expired`` the newest of those that would go."""
    gone = retained(snapshots, labelled).where("not retained").drop("retained")
    among = snapshots if keep == "newest" else gone
    spared = among.groupBy("scheme").agg(F.max_by("snapshotid", F.struct("timestamp", "snapshotid")).alias("snapshotid")).select("snapshotid")
    return gone.join(spared, "snapshotid", "left_anti")


def latest(snapshots: DataFrame) -> DataFrame:
    """Per scheme: the greatest id and the number of snapshots."""
    return snapshots.groupBy("scheme").agg(F.max("snapshotid").alias("latest"), F.count("*").alias("snapshots"))


def size_series(members: DataFrame, order: str = "snapshot", item: str = "segmentid", size: str = "bytes") -> DataFrame:
    """Per snapshot, against the one before: items and bytes added and removed, and the total.

    ``members`` has distinct (snapshot, item) rows with a size per item. Snapshots are few;
    members are matched by their item and numbered snapshot.
    """
    numbered = members.select(order).distinct().withColumn("n", F.row_number().over(Window.orderBy(order)))
    rows = members.join(numbered, order)
    here = rows.select("n", item, size)
    added = here.join(here.select((F.col("n") + 1).alias("n"), item), ["n", item], "left_anti").groupBy("n").agg(F.count("*").alias("added"), F.sum(size).alias("added_bytes"))
    gone = here.select((F.col("n") + 1).alias("n"), item, size).join(here.select("n", item), ["n", item], "left_anti").groupBy("n").agg(F.count("*").alias("removed"), F.sum(size).alias("removed_bytes"))
    out = numbered.join(added, "n", "left").join(gone, "n", "left").na.fill(0)
    total = F.sum(F.col("added_bytes") - F.col("removed_bytes")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("total_bytes", total).drop("n")
