from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boostlab.streaming import telemetry

SCHEMA = "ts timestamp, device_id int, util int"
START = datetime(2024, 1, 1)


def rows(n):
    return [(START + timedelta(minutes=7 * i), i % 3, (i * 37) % 101) for i in range(n)]


def test_rollup_of_no_samples_is_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert telemetry.rollup(empty).count() == 0
    assert telemetry.device_set(empty).count() == 0


def test_rollup_rounds_to_one_decimal(spark):
    df = spark.createDataFrame([(START, 0, 1), (START, 0, 2), (START, 0, 2)], SCHEMA)
    assert telemetry.rollup(df).collect() == [(0, 1.7, 2)]


def test_stream_over_several_batches_equals_the_table(spark, tmp_path):
    """Windows that span batches, and the ones still open at the end, are all there."""
    folder = str(tmp_path / "landing")
    for part in range(4):
        spark.createDataFrame(rows(200)[part::4], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    streamed = telemetry.drain(spark, stream, "1 hour", "2 days")
    batch = telemetry.windowed(spark.createDataFrame(rows(200), SCHEMA), "1 hour", "2 days")
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_append_mode_gives_closed_windows_once(spark, tmp_path):
    folder = str(tmp_path / "landing")
    for part in range(3):
        spark.createDataFrame(rows(200)[part::3], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sorted(telemetry.drain_closed(spark, stream, "1 hour", "2 days").collect())
    table = spark.createDataFrame(rows(200), SCHEMA)
    last = table.agg(F.max("ts")).first()[0]
    closed = [r for r in telemetry.windowed(table, "1 hour", "2 days").collect()
              if r["window_start"] + timedelta(hours=1) <= last - timedelta(days=2)]
    assert got == sorted(closed)


def test_stream_without_files_has_no_windows(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
    assert telemetry.drain(spark, stream).count() == 0
    assert telemetry.drain_closed(spark, stream).count() == 0
