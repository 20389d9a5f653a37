"""File trees: contents by ``binaryFile``, stat fields by a Python data source."""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, type string, mode int, size long, ctime long, mtime long, uid long, gid long, links int, inode string, target string"


class _Part(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [_Part(n) for n in sorted(os.listdir(self.root))]

    def read(self, partition: _Part):
        def walk(rel: str):
            full = os.path.join(self.root, rel)
            s = os.lstat(full)
            kinds = ((stat.S_ISREG, "f"), (stat.S_ISDIR, "d"), (stat.S_ISLNK, "l"), (stat.S_ISFIFO, "p"), (stat.S_ISSOCK, "s"), (stat.S_ISBLK, "b"), (stat.S_ISCHR, "c"))
            kind = next((k for test, k in kinds if test(s.st_mode)), "?")
            yield (rel, kind, stat.S_IMODE(s.st_mode), s.st_size, int(s.st_ctime), int(s.st_mtime), s.st_uid, s.st_gid, s.st_nlink, f"{os.major(s.st_dev)}/{os.minor(s.st_dev)}/{s.st_ino}", os.readlink(full) if kind == "l" else None)
            if kind == "d":
                for name in sorted(os.listdir(full)):
                    yield from walk(f"{rel}/{name}")

        yield from walk(partition.name)


class TreeSource(DataSource):
    """``spark.read.format("tree").load(root)``: a row per file, directories before what they hold; one partition per entry of the root. The root must be visible to executors."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").load(root)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """``path`` relative to ``root``, ``content`` and ``length`` of every file, read by Spark itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.expr(f"substring_index(path, '{root.rstrip('/')}/', -1)").alias("path"), "content", "length")
