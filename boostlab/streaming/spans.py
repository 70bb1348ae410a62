"""Device samples of each run's own time span, in batch and as a stream.

A sample belongs to every run that was under way when it was taken. Spans are cut into
buckets of time, so samples meet runs by an equi-join on the bucket, whatever a run's length,
and the exact bounds are tested there. Sums per run and device are taken before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.session import run_dir

BUCKET_SECONDS = 60
#: The longest span a stream expects. It bounds the samples that are kept for runs yet to
#: stop; a longer run is an error, as samples of it may be gone.
LONGEST = "1 day"


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def cut_spans(runs: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per run and bucket it touches. A run without start or stop, or that stops
    before it starts, touches none."""
    first, last = _bucket(F.col("start"), seconds), _bucket(F.col("stop"), seconds)
    return runs.filter("start <= stop").withColumn("_bucket", F.explode(F.sequence(first, last)))


def in_spans(samples: DataFrame, runs: DataFrame, by: Sequence[str],
             seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Samples (``ts, device_id, util``) beside the key of every run under way, both ends
    of its span included."""
    spans = cut_spans(runs.select(*by, "start", "stop"), seconds)
    taken = samples.select("ts", "device_id", "util",
                           _bucket(F.col("ts"), seconds).alias("_bucket"))
    return (
        taken.join(spans, "_bucket").filter(F.col("ts").between(F.col("start"), F.col("stop")))
        .select(*by, "ts", "device_id", "util")
    )


def _partial(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    return matched.groupBy(*by, "device_id").agg(
        F.count("util").alias("n"), F.sum("util").alias("total"), F.max("util").alias("most"))


def _finished(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean to one decimal and maximum from partial sums of any number of parts."""
    return partial.groupBy(*by, "device_id").agg(
        F.round(F.try_divide(F.sum("total").cast("double"), F.sum("n")), 1).alias("avg_util"),
        F.max("most").alias("max_util"))


def run_stats(samples: DataFrame, runs: DataFrame, by: Sequence[str] = ("run",),
              seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``avg_util, max_util`` per run and device; a run without samples has no row."""
    return _finished(_partial(in_spans(samples, runs, by, seconds), by), by)


def drain_runs(
    spark: SparkSession, samples: DataFrame, runs: DataFrame, by: Sequence[str] = ("run",),
    late: str = "10 minutes", longest: str = LONGEST, seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """The same from two streams until their input is used up: samples, and runs that are
    told of when they stop.

    A run is matched as soon as its stop arrives, with the samples held so far, and later
    ones as they come. Samples are held until no run of the ``longest`` span can reach them,
    runs until no sample can be that ``late``. Each batch writes sums into its own folder,
    so a repeated batch replaces itself, and the reader adds the batches up.
    """
    home = run_dir(spark, "spans")
    out = f"{home}/parts"
    span = F.expr(f"interval {longest}")
    fits = F.when(F.col("stop") > F.col("start") + span, F.raise_error(
        F.lit(f"a run longer than {longest}"))).otherwise(F.col("stop"))
    # A run is told of once it has stopped: its stop is its event time.
    told = cut_spans(
        runs.select(*by, "start", fits.alias("stop")).withWatermark("stop", late), seconds)
    taken = samples.select(
        "ts", "device_id", "util", _bucket(F.col("ts"), seconds).alias("_at")
    ).withWatermark("ts", late)
    matched = taken.join(
        told, (F.col("_at") == F.col("_bucket")) & (F.col("ts") >= F.col("start"))
        & (F.col("ts") <= F.col("stop")) & (F.col("stop") <= F.col("ts") + span)
    ).select(*by, "device_id", "util")
    schema = _partial(spark.createDataFrame([], matched.schema), by).schema

    def keep(rows: DataFrame, batch: int) -> None:
        _partial(rows, by).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")
    running = (
        matched.writeStream.outputMode("append").option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    running.awaitTermination()
    return _finished(spark.read.schema(schema.add("batch", "long")).parquet(out), by)
