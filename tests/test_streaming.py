from pyspark.sql import functions as F

from snapweave.streaming import incremental


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:10:00"), ("b", 2, "2024-01-01 00:20:00")], "checksum string, size long, t string").select("checksum", "size", F.col("t").cast("timestamp").alias("ts"))
    rows.write.parquet(src)
    q = incremental.new_blocks(spark.readStream.schema(rows.schema).parquet(src)).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.checksum for r in spark.table("fresh").collect()} == {"a", "b"} and spark.table("fresh").count() == 2

    refs = spark.createDataFrame([(1, 1, "o", 5, 10), (1, 1, "o", 9, 10)], "snapshotid int, segmentid int, object string, length long, size long")
    refs.write.parquet(str(tmp_path / "refs"))
    q = incremental.append_utilization(spark.readStream.schema(refs.schema).parquet(str(tmp_path / "refs")), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert [r.bytes_referenced for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [9]
