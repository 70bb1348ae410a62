"""Handing a dataset over to another job through the shared folder, sealed by content.

A hand-over is a folder of rows and a manifest, which is written last: without it there is
nothing to receive. Every row carries a hash of its columns, taken where the row was made.
The manifest holds, per file, its row count and a sum of hashes per column, so a reader
finds a changed value, a lost, added or exchanged file, and names them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boostlab.session import run_dir

ROWS, MANIFEST = "rows", "manifest"
#: Column and file names that a message lists at most; every fault is counted.
NAMED = 5


class BrokenHandOver(ValueError):
    """What was received is not what was handed over."""


def _total(value: Column) -> Column:
    """An order-free sum of hashes that cannot overflow (a file has under 10^10 rows)."""
    return F.sum(value.cast("decimal(20,0)"))


def _seal_name(columns: list[str]) -> str:
    name = "_seal"
    while name in columns:
        name += "_"
    return name


def _sums(rows: DataFrame, columns: list[str], seal: str) -> DataFrame:
    """Per file: rows, rows whose seal does not fit them, and a sum of hashes per column."""
    per_column = [_total(F.xxhash64(c)).cast("string").alias(c) for c in columns]
    kept = F.xxhash64(*columns)
    return rows.groupBy(F.substring_index(F.input_file_name(), "/", -1).alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col(seal).eqNullSafe(kept)).alias("spoiled"),
        _total(F.col(seal)).cast("string").alias("seals"),
        F.struct(*per_column).alias("columns"),
    )


def hand_over(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a dataset with its manifest and return what a reader receives.

    The source is read once. Its rows are sealed in the pass that writes them, and the
    manifest is taken from the written files, whose rows must fit their seals.
    """
    spark = df.sparkSession
    path = path or run_dir(spark, "dataset")
    seal = _seal_name(df.columns)
    sealed = df.withColumn(seal, F.xxhash64(*df.columns))
    sealed.write.mode("errorifexists").parquet(f"{path}/{ROWS}")
    written = spark.read.schema(sealed.schema).parquet(f"{path}/{ROWS}")
    # One row per file, and one of the schema alone.
    schema = spark.createDataFrame([(df.schema.json(),)], "schema string")
    manifest = _sums(written, df.columns, seal).unionByName(schema, allowMissingColumns=True)
    manifest.write.mode("errorifexists").parquet(f"{path}/{MANIFEST}")
    if not spark.read.parquet(f"{path}/{MANIFEST}").filter("spoiled > 0").isEmpty():
        raise BrokenHandOver("rows changed while they were written")
    return receive(spark, path)


def faults(spark: SparkSession, path: str) -> DataFrame:
    """``file, fault, columns``: files that are missing, added or hold other rows than the
    manifest says, with the columns that differ. One pass over the rows, one row per file."""
    manifest = spark.read.parquet(f"{path}/{MANIFEST}")
    schema = _schema(manifest)
    columns = manifest.schema["columns"].dataType.names
    seal = _seal_name(columns)
    rows = spark.read.schema(schema.add(seal, "long")).parquet(f"{path}/{ROWS}")
    found = _sums(rows, columns, seal).select("file", F.struct("*").alias("found"))
    sent = manifest.filter("schema is null").drop("schema").select(
        "file", F.struct("*").alias("sent"))
    differ = F.array_compact(F.array(*[
        F.when(F.col(f"sent.columns.{_quoted(c)}") != F.col(f"found.columns.{_quoted(c)}"),
               F.lit(c)) for c in columns]))
    fault = (
        F.when(F.col("found").isNull(), "missing").when(F.col("sent").isNull(), "added")
        .when(F.col("sent.n_rows") != F.col("found.n_rows"), "row count")
        .when((F.col("found.spoiled") > 0) | (F.col("sent.seals") != F.col("found.seals"))
              | (F.size(differ) > 0), "content")
    )
    return (
        sent.join(found, "file", "full").withColumn("fault", fault)
        .filter("fault is not null").select("file", "fault", differ.alias("columns"))
    )


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _schema(manifest: DataFrame) -> T.StructType:
    row = manifest.filter("schema is not null").select("schema").first()
    return T.StructType.fromJson(json.loads(row[0]))


def receive(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a finished hand-over, once every file of it has been checked."""
    wrong = faults(spark, path)
    some = wrong.orderBy("file").limit(NAMED).collect()
    if some:
        raise BrokenHandOver(f"{wrong.count()} files differ, such as " + ", ".join(
            f"{r['file']} ({r['fault']}{': ' + ', '.join(r['columns'][:NAMED]) if r['columns'] else ''})"
            for r in some))
    return spark.read.schema(_schema(spark.read.parquet(f"{path}/{MANIFEST}"))).parquet(
        f"{path}/{ROWS}")
