"""Running sums over a global order, without sorting the table in one task.

Rows are cut into value ranges of similar size. Sums per range are few, so
their running total is cheap; rows are then ordered only inside their range.
The cut points steer balance and never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boostlab.operators.quantiles import quantiles

def range_count(df: DataFrame) -> int:
    """Ranges to cut a table into: several per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, 4 * partitions)


def add_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_range``, the range number, for every given column.

    A value holding a large share of the rows has a range of its own or shares one with
    less frequent neighbours.
    """
    bounds = quantiles(df, columns, range_count(df), balance=True)
    infinite = float("inf")
    inner = [[b for b in bounds[c] if -infinite < b < infinite] for c in columns]
    return Bucketizer(
        inputCols=list(columns),
        outputCols=[f"{c}_range" for c in columns],
        splitsArray=[[-infinite, *(b or [0.0]), infinite] for b in inner],
    ).transform(df)


def running_sums(
    df: DataFrame, order: str, bucket: str, sums: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<name>_before``: the sum over all rows ordered before this one.

    ``df`` has one row per (``by``, ``order``), and ``bucket`` rises with ``order``.
    """
    keys = [*by, bucket]
    totals = df.groupBy(*keys).agg(*[F.sum(s).alias(f"{s}_total") for s in sums])
    before = (
        Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"{s}_total").over(before), F.lit(0)).alias(f"{s}_offset") for s in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"{s}_inside") for s in sums]
    )
    joined = local.join(offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"{s}_inside") + F.col(f"{s}_offset")).alias(f"{s}_before") for s in sums],
    )
