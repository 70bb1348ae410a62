"""Device telemetry, rolled up in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.session import run_dir


def rollup(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean utilisation to one decimal and its maximum, per device."""
    return samples.groupBy(*by, "device_id").agg(
        F.round(F.avg("util"), 1).alias("avg_util"), F.max("util").alias("max_util")
    )


def device_set(samples: DataFrame) -> DataFrame:
    """Every device seen, ascending."""
    return samples.select("device_id").distinct().orderBy("device_id")


def windowed(samples: DataFrame, width: str, late: str) -> DataFrame:
    """Rollup per tumbling window and device; works on streams and on tables."""
    watched = samples.withWatermark("ts", late) if samples.isStreaming else samples
    return (
        watched.groupBy(F.window("ts", width).alias("w"), "device_id")
        .agg(
            F.count("*").alias("n_samples"),
            F.round(F.avg("util"), 1).alias("avg_util"),
            F.max("util").alias("max_util"),
        )
        .select(F.col("w.start").alias("window_start"), "device_id", "n_samples",
                "avg_util", "max_util")
    )


def drain(spark: SparkSession, stream: DataFrame, width: str = "1 hour",
          late: str = "1 hour") -> DataFrame:
    """Run a sample stream until its input is used up; the latest row per window and device.

    Every micro-batch writes only the windows it changed, into its own folder, so
    a repeated batch replaces itself and nothing gathers on the driver. Windows
    the watermark has not closed yet are part of the result.
    """
    home = run_dir(spark, "telemetry")
    out = f"{home}/windows"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    rolled = windowed(stream, width, late)
    # A stream without files runs no batch; then there are no windows.
    spark.createDataFrame([], rolled.schema).write.parquet(f"{out}/batch=-1")
    running = (
        rolled.writeStream.outputMode("update")
        .option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    running.awaitTermination()
    values = ["n_samples", "avg_util", "max_util"]
    written = spark.read.schema(rolled.schema.add("batch", "long")).parquet(out)
    return (
        written.groupBy("window_start", "device_id")
        .agg(F.max_by(F.struct(*values), "batch").alias("last"))
        .select("window_start", "device_id", "last.*")
    )


def drain_closed(spark: SparkSession, stream: DataFrame, width: str = "1 hour",
                 late: str = "1 hour") -> DataFrame:
    """Run a sample stream until its input is used up; each window and device once, as soon
    as the watermark has closed it. Windows still open at the end are not part of the result."""
    home = run_dir(spark, "telemetry")
    rolled = windowed(stream, width, late)
    # What a reader finds if no window was ever closed.
    spark.createDataFrame([], rolled.schema).write.parquet(f"{home}/closed")
    running = (
        rolled.writeStream.outputMode("append").format("parquet")
        .option("path", f"{home}/closed")
        .option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(rolled.schema).parquet(f"{home}/closed")
