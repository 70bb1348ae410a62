"""Comparison and scaling reports over flat result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boostlab.functions.scalars import (
    efficiency_note, faster_flag, is_cpu, library, ratio, speedup_text,
)


def speedup_vs_cpu(runs: DataFrame) -> DataFrame:
    """Speedup over the CPU row of the same library and round count.

    The last CPU row of a library is its baseline. CPU rows, and rows without a
    baseline or with a zero one, show ``-``. Result rows are few, one per
    configuration; the join is left to the optimizer's own size check.
    """
    named = runs.withColumn("lib", library(F.col("name")))
    baseline = (
        named.filter(is_cpu(F.col("name")))
        .groupBy("iterations", "lib")
        .agg(F.max_by("time_seconds", "pos").alias("cpu_time"))
    )
    shown = (F.col("cpu_time") != 0) & ~is_cpu(F.col("name"))
    speedup = F.when(shown, ratio(F.col("cpu_time"), F.col("time_seconds")))
    return (
        named.join(baseline, ["iterations", "lib"], "left")
        .withColumn("speedup", speedup)
        .withColumn("speedup_text", speedup_text(F.col("speedup")))
        .select("iterations", "name", "time_seconds", "accuracy", "auc", "speedup", "speedup_text")
    )


def single_vs_distributed(single: DataFrame, distributed: DataFrame, key: list[str]) -> DataFrame:
    """Speedup of the distributed run of each library, with both AUC values."""
    one = single.select(*key, F.col("time").alias("t_single"), F.col("auc").alias("auc_single"))
    many = distributed.select(*key, F.col("time").alias("t_dist"), F.col("auc").alias("auc_dist"))
    return one.join(many, key).withColumn("speedup", ratio(F.col("t_single"), F.col("t_dist")))


def scaling_efficiency(compared: DataFrame, workers: int) -> DataFrame:
    """Percent of ideal speedup, with a note by band."""
    percent = F.col("speedup") / F.lit(workers) * F.lit(100.0)
    return compared.withColumn("efficiency", percent).withColumn(
        "note", efficiency_note(F.col("efficiency"))
    )


def speedup_vs_named(runs: DataFrame, baseline: str) -> DataFrame:
    """Speedup of every method over one named method of the same round count."""
    named = F.max(F.when(F.col("name") == baseline, F.col("time_seconds")))
    base_time = named.over(Window.partitionBy("iterations"))
    return runs.withColumn("speedup", ratio(base_time, F.col("time_seconds")))


def best_of(runs: DataFrame) -> DataFrame:
    """Fastest and most accurate method per round count; the first in order wins a tie."""
    return runs.groupBy("iterations").agg(
        F.min(F.struct("time_seconds", "pos", "name")).alias("fast"),
        F.min(F.struct((-F.col("auc")).alias("auc"), F.col("pos"), F.col("name"))).alias("good"),
    ).select(
        "iterations",
        F.col("fast.name").alias("fastest"),
        F.col("fast.time_seconds").alias("time_seconds"),
        F.col("good.name").alias("best_auc_name"),
        (-F.col("good.auc")).alias("best_auc"),
    )


def compare_runs(ours: DataFrame, published: DataFrame, tolerance: float) -> DataFrame:
    """A run beside a published one: differences, and what either side lacks."""
    keys = ["iterations", "name"]
    a = ours.select(*keys, F.col("time_seconds").alias("time_a"), F.col("auc").alias("auc_a"))
    b = published.select(*keys, F.col("time_seconds").alias("time_b"), F.col("auc").alias("auc_b"))
    delta = F.col("auc_a") - F.col("auc_b")
    status = (
        F.when(F.col("time_b").isNull(), "only_ours")
        .when(F.col("time_a").isNull(), "only_published")
        .when(F.abs(delta) <= tolerance, "same")
        .otherwise("differs")
    )
    return a.join(b, keys, "full").select(
        *keys,
        F.round(F.col("time_a") - F.col("time_b"), 6).alias("time_delta"),
        F.round(delta, 6).alias("auc_delta"),
        status.alias("status"),
    )


def union_results(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Append result rows; a column one side lacks is null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def sweep_speedup(sizes: DataFrame) -> DataFrame:
    """Speedup by table size, marked faster only strictly above one."""
    speedup = ratio(F.col("t_single"), F.col("t_dist"))
    return sizes.withColumn("speedup", speedup).withColumn("flag", faster_flag(F.col("speedup")))


def crossover(sizes: DataFrame) -> DataFrame:
    """The first size, in sweep order, at which the distributed run is faster."""
    faster = F.col("speedup") > 1
    first = F.min(F.when(faster, F.struct("n_samples", "name"))).alias("hit")
    found = F.concat(F.lit("distributed becomes faster at "), F.col("hit.name"))
    return sweep_speedup(sizes).agg(first).select(
        F.col("hit.name").alias("name"),
        F.col("hit.n_samples").alias("n_samples"),
        F.coalesce(found, F.lit("single is faster for all sizes")).alias("message"),
    )


def overhead_rate(sizes: DataFrame) -> DataFrame:
    """Overhead of the distributed run and the data rate it stands for."""
    megabytes = F.col("n_samples") * F.col("n_features") * 4 / F.lit(1e6)
    overhead = F.col("t_dist") - F.col("t_single")
    return sizes.select(
        "name",
        F.round(megabytes, 6).alias("megabytes"),
        F.round(overhead, 6).alias("overhead"),
        F.round(ratio(megabytes, overhead), 4).alias("rate"),
    )


# Fixed value: bytes of histogram a node exchanges.
NODE_BYTES = 200 * 1024


def exchange_volume(runs: DataFrame, depths: list[int]) -> DataFrame:
    """Histogram bytes exchanged per tree and per run, by tree depth."""
    per_tree = (F.pow(F.lit(2), F.col("depth")) * NODE_BYTES).cast("bigint")
    return (
        runs.select("iterations", "name", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
        .withColumn("per_tree", per_tree)
        .withColumn("per_run", F.col("per_tree") * F.col("iterations"))
    )


def run_status(log: DataFrame) -> DataFrame:
    """Runs per outcome by test name; failures and timeouts are both not passed."""
    passed = F.col("outcome") == "passed"
    return log.groupBy("name").agg(
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("not_passed"),
        F.bool_and(passed).alias("all_passed"),
    )
