"""Result documents: nested JSON of hardware, parameters and benchmark results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = T.StructType([
    T.StructField("time_seconds", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("auc", T.DoubleType()),
    T.StructField("gpu_stats", T.MapType(T.StringType(), T.DoubleType())),
])

GPU = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("memory_mb", T.IntegerType()),
    T.StructField("driver", T.StringType()),
])

# The field names of a result document.
DOCUMENT = T.StructType([
    T.StructField("hardware", T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("python_version", T.StringType()),
        T.StructField("cpu_count", T.IntegerType()),
        T.StructField("cpu_model", T.StringType()),
        T.StructField("gpus", T.ArrayType(GPU)),
        T.StructField("gpu_count", T.IntegerType()),
        T.StructField("cuda_version", T.StringType()),
        T.StructField("gpu_error", T.StringType()),
        T.StructField("xgboost_version", T.StringType()),
        T.StructField("catboost_version", T.StringType()),
        T.StructField("lightgbm_version", T.StringType()),
    ])),
    T.StructField("parameters", T.StructType([
        T.StructField("samples", T.LongType()),
        T.StructField("features", T.IntegerType()),
        T.StructField("iterations", T.ArrayType(T.IntegerType())),
        T.StructField("depth", T.IntegerType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("lightgbm_num_leaves", T.IntegerType()),
    ])),
    T.StructField("benchmarks", T.ArrayType(T.StructType([
        T.StructField("iterations", T.IntegerType()),
        T.StructField("results", T.MapType(T.StringType(), RESULT)),
    ]))),
])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Result documents, one row per file. The schema is given: inferring it would
    turn the maps into one column per key."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def write_document(document: DataFrame, path: str, replace: bool = False) -> None:
    """One document as one JSON file, which appears whole or not at all. A document holds a
    sweep's few result rows."""
    spark = document.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    target, beside = place(path), f"{path}.{uuid.uuid4().hex}"
    files = target.getFileSystem(conf)
    if files.exists(target) and not replace:
        raise FileExistsError(path)
    document.coalesce(1).write.json(beside)
    try:
        part, = [f.getPath() for f in files.globStatus(place(f"{beside}/part-*"))]
        if replace:
            files.delete(target, False)
        if not files.rename(part, target):
            raise OSError(f"{path} could not be written")
    finally:
        files.delete(place(beside), True)


def stats_map(stats: DataFrame, key: list[str]) -> DataFrame:
    """Device rows ``(device_id, avg_util, max_util)`` as one ``gpu_stats`` map per key."""
    def entry(suffix: str, value: str):
        name = F.concat(F.lit("gpu"), F.col("device_id").cast("string"), F.lit(suffix))
        return F.struct(name.alias("key"), F.col(value).cast("double").alias("value"))

    pair = F.array(entry("_avg_util", "avg_util"), entry("_max_util", "max_util"))
    return stats.groupBy(*key).agg(
        F.map_from_entries(F.flatten(F.array_sort(F.collect_list(pair)))).alias("gpu_stats")
    )


def nest_results(runs: DataFrame) -> DataFrame:
    """Flat result rows, with a ``gpu_stats`` map, as the ``benchmarks`` array of one document.

    Results keep their run order (``pos``). A document is one sweep: its rows are
    as many as its configurations, however large the tables were.
    """
    result = F.struct("time_seconds", "accuracy", "auc", "gpu_stats")

    def by_position(x, y):
        before = (x["pos"] < y["pos"]) | ((x["pos"] == y["pos"]) & (x["name"] < y["name"]))
        return F.when(before, -1).otherwise(1)

    entry = F.struct("pos", "name", result.alias("result"))
    per_round = runs.groupBy("iterations").agg(F.collect_list(entry).alias("entries"))
    named = F.map_from_entries(
        F.transform(
            F.array_sort("entries", by_position),
            lambda e: F.struct(e["name"].alias("key"), e["result"].alias("value")),
        )
    )
    bench = F.struct(F.col("iterations"), named.alias("results"))
    return per_round.agg(
        F.array_sort(F.collect_list(bench), lambda x, y: x["iterations"] - y["iterations"])
        .alias("benchmarks")
    )


def flatten_results(documents: DataFrame) -> DataFrame:
    """One row per (iterations, configuration) of result documents."""
    return (
        documents.select(F.explode("benchmarks").alias("b"))
        .select("b.iterations", F.explode("b.results").alias("name", "r"))
        .select("iterations", "name", "r.*")
    )


def device_stats_long(flat: DataFrame) -> DataFrame:
    """One row per device of every run; a run without samples keeps a row of nulls."""
    entry = flat.select("iterations", "name", F.explode_outer("gpu_stats").alias("stat", "value"))
    device = F.regexp_extract("stat", "^gpu([0-9]+)_", 1).try_cast("int")
    return (
        entry.withColumn("device_id", device)
        .groupBy("iterations", "name", "device_id")
        .agg(
            F.max(F.when(F.endswith("stat", F.lit("_avg_util")), F.col("value"))).alias("avg_util"),
            F.max(F.when(F.endswith("stat", F.lit("_max_util")), F.col("value")))
            .cast("int").alias("max_util"),
        )
    )
