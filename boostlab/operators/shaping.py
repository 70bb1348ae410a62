"""Casts, splits and row layout of training tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlab.functions import rand
from boostlab.functions.scalars import int_div


def cast_features(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Features to float32, label to int32; other columns stay."""
    casts = {f: F.col(f).cast("float") for f in features}
    return df.withColumns({**casts, label: F.col(label).cast("int")})


def split_hash(df: DataFrame, row_id: str, test_share: float, seed: int = 42) -> DataFrame:
    """Add ``is_test`` by comparing a hash uniform with the share: one pass, no shuffle."""
    u = rand.uniform(seed, "split", F.col(row_id))
    return df.withColumn("is_test", u < F.lit(test_share))


def split_exact(df: DataFrame, row_id: str, test_share: float, seed: int = 42) -> DataFrame:
    """Add ``is_test`` for exactly ``ceil(share * n)`` rows in a seeded random order.

    The order is (hash word, id). The cut row is found by counting: first by the
    upper half of the word, then by the lower half inside one upper half. Each
    count has at most 65,536 groups; only rows sharing the cut word are sorted.
    """
    word = rand.word(seed, "split", F.col(row_id))
    keyed = df.select(F.col(row_id).alias("_id"), word.alias("_word"))
    wanted = math.ceil(round(keyed.count() * test_share, 6))
    if wanted == 0:
        return df.withColumn("is_test", F.lit(False))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    for shift in (16, 0):
        counts = keyed.groupBy(F.shiftright("_word", shift).alias("part")).agg(
            F.count("*").alias("n")
        )
        cut = (
            counts.select("part", "n", F.sum("n").over(upto).alias("upto"))
            .filter((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
            .first()
        )
        wanted -= cut["upto"] - cut["n"]
        keyed = keyed.filter(F.shiftright("_word", shift) == cut["part"])
    last = keyed.orderBy("_id").offset(wanted - 1).first()
    last_word, last_id = F.lit(last["_word"]), F.lit(last["_id"])
    return df.withColumn(
        "is_test", (word < last_word) | ((word == last_word) & (F.col(row_id) <= last_id))
    )


def split_positional(df: DataFrame, row_id: str, train_share: float = 0.8) -> DataFrame:
    """Add ``is_test``: rows from ``int(share * n)`` on, by dense id."""
    cut = df.select(F.floor(F.count("*") * F.lit(train_share))).scalar()
    return df.withColumn("is_test", F.col(row_id) >= cut)


def chunk_rows(n_rows: Column, workers: Column) -> dict[str, Column]:
    """Rows per chunk under each of the known layout rules."""
    # The rules' factors, the floor of 10,000 rows and the fixed 25,000.
    return {
        "per_worker": int_div(n_rows, workers),
        "half_worker_min1": F.greatest(F.lit(1).cast("bigint"), int_div(n_rows, 2 * workers)),
        "half_worker": int_div(n_rows, 2 * workers),
        "quarter_worker": F.greatest(int_div(n_rows, 4 * workers), F.lit(10000).cast("bigint")),
        "fixed": F.lit(25000).cast("bigint"),
    }


def chunk_census(df: DataFrame, row_id: str, workers: int) -> DataFrame:
    """Rows in every chunk, for every layout rule; a remainder makes a short last chunk."""
    n_rows = df.select(F.count("*")).scalar()
    rules = chunk_rows(n_rows, F.lit(workers))
    sized = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("size")) for k, v in rules.items()])
    return (
        df.select(row_id, F.explode(sized).alias("r"))
        .select(F.col("r.rule").alias("rule"),
                int_div(F.col(row_id), F.col("r.size")).alias("chunk"))
        .groupBy("rule", "chunk")
        .agg(F.count("*").alias("n_rows"))
    )


def lay_out(df: DataFrame, row_id: str, partitions: int) -> DataFrame:
    """Rows cut by id ranges and ordered inside, so a seeded fit repeats exactly."""
    return df.repartitionByRange(partitions, row_id).sortWithinPartitions(row_id)


def megabytes(n_rows: Column, n_features: Column) -> Column:
    """Size of a float32 table."""
    return n_rows * n_features * F.lit(4) / F.lit(1e6)
