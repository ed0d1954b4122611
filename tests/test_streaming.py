"""Streaming bars equal batch bars."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemill.streaming.rolling import daily_bars


def test_daily_bars(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=7 * k), "AB"[k % 2], 10.0 + k, 1.0) for k in range(60)]
    ticks = spark.createDataFrame(rows, "ts timestamp, ticker string, price double, volume double")
    ticks.where(F.col("ts") < "2024-01-09").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    ticks.where(F.col("ts") >= "2024-01-09").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = daily_bars(stream).writeStream.outputMode("complete").format("memory").queryName("bars").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("bars").collect()) == sorted(daily_bars(ticks).collect())
