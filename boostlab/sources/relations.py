"""Relations over the test tables that stand in for the inputs of the dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.functions import rand

SEED = 42
ORDER_FEATURES = ["f0", "f1", "f2", "f3"]
MEMBERS = ["p1", "p2", "p3", "p4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: ``row_id, label, score``; four digits, so scores tie."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.round(1.0 / (1.0 + F.exp(-(F.col("value") - 50.0) / 25.0)), 4).alias("score"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with one probability column per ensemble member."""
    mixed = [
        (0.5 * F.col("score") + 0.5 * rand.uniform(i, "member", F.col("row_id"))).alias(name)
        for i, name in enumerate(MEMBERS, start=1)
    ]
    return scores(spark, sf_dir).select("row_id", "label", *mixed)


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows, one per order: line aggregates as features, and a label.

    Lines are aggregated before the join, so an order with very many lines
    costs one partial row per map task; both sides then share the key.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("row_id"))
        .agg(
            F.count("*").cast("double").alias("f0"),
            F.sum("l_quantity").alias("f1"),
            F.round(F.avg("l_discount"), 6).alias("f2"),
            F.max("l_tax").alias("f3"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    features = orders.join(lines, "row_id", "left").select(
        "row_id", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in ORDER_FEATURES]
    )
    signal = (
        0.01 * F.col("f1") + 5.0 * F.col("f2") + 0.2 * rand.uniform(SEED, "x3", F.col("row_id"))
    )
    return features.withColumn("label", (signal > 1.35).cast("int"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device samples: ``ts, device_id, util, mem_used, mem_total``."""
    return telemetry_columns(table(spark, sf_dir, "events"))


def telemetry_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 4).cast("int").alias("device_id"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("util"),
        F.floor(F.col("value") * 10).cast("int").alias("mem_used"),
        F.lit(24570).alias("mem_total"),
    )


def spans(events: DataFrame) -> DataFrame:
    """Every fifth purchase as a run of as many minutes as its value: ``run, start, stop``."""
    ts = F.col("ts").cast("timestamp")
    length = F.make_dt_interval(mins=F.floor("value").cast("int"))
    return events.filter("event_type = 'purchase' AND event_id % 5 = 0").select(
        F.col("event_id").alias("run"), ts.alias("start"), (ts + length).alias("stop"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat result rows: ``iterations, pos, name, time_seconds, accuracy, auc``.

    One library has no CPU row and one has two, as result files may.
    """
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    lib = F.lower(F.substring(priority, 3, 20))
    pos = F.when(status == "F", 0).when(status == "O", 1).otherwise(2)
    config = (
        F.when((lib == "low") & (status == "F"), "2gpu")
        .when((lib == "high") & (status == "O"), "cpu_again")
        .when(status == "F", "cpu")
        .when(status == "O", "1gpu")
        .otherwise("4gpu_dask")
    )
    bucket = F.col("o_orderkey") % 3
    iterations = F.when(bucket == 0, 100).when(bucket == 1, 500).otherwise(1000)
    return (
        table(spark, sf_dir, "orders")
        .select(
            iterations.alias("iterations"),
            pos.alias("pos"),
            F.concat_ws("_", lib, config).alias("name"),
            "o_totalprice",
            "o_custkey",
        )
        .groupBy("iterations", "pos", "name")
        .agg(
            F.round(F.avg("o_totalprice") / 1000.0, 2).alias("time_seconds"),
            F.round(F.avg((F.col("o_totalprice") > 50000).cast("double")), 4).alias("accuracy"),
            F.round(F.avg((F.col("o_custkey") % 25 > 0).cast("double")), 4).alias("auc"),
        )
    )


def published_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another run of the same kind, with other round counts: ``iterations, name, ...``."""
    lib = F.lower(F.substring(F.col("o_orderpriority"), 3, 20))
    config = F.when(F.col("o_orderstatus") == "F", "cpu").otherwise("1gpu")
    bucket = F.col("o_custkey") % 3
    iterations = F.when(bucket == 0, 100).when(bucket == 1, 500).otherwise(2000)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(iterations.alias("iterations"), F.concat_ws("_", lib, config).alias("name"))
        .agg(
            F.round(F.avg("o_totalprice") / 1000.0, 2).alias("time_seconds"),
            F.round(F.avg((F.col("o_custkey") % 25 > 0).cast("double")), 4).alias("auc"),
        )
    )


def bench_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep results by size: ``name, n_samples, n_features, t_single, t_dist``."""
    even = F.col("o_orderkey") % 2 == 0
    price = F.col("o_totalprice") / 1000.0
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.month("o_orderdate").alias("month"))
        .agg(
            F.count("*").alias("n_samples"),
            F.round(F.avg(F.when(even, price)), 2).alias("t_single"),
            F.round(F.avg(F.when(~even, price)), 2).alias("t_dist"),
        )
        .select(
            F.concat(F.lit("m"), F.col("month").cast("string")).alias("name"),
            "n_samples",
            F.lit(50).alias("n_features"),
            "t_single",
            "t_dist",
        )
    )


def wide_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per embedding element, with a binary label; all have the same length."""
    vector = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings")
    width, longest = rows.select(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if width != longest:
        raise ValueError(f"embeddings of {width} to {longest} elements")
    return rows.select(
        F.col("vec_id").alias("row_id"),
        *[vector.getItem(i).cast("double").alias(f"f{i}") for i in range(width or 0)],
        (F.col("label") < 5).cast("int").alias("label"),
    )
