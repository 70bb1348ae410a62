"""Quantile bin edges, and bins of feature values.

An edge is a value of the table: the smallest one with at least a share
``k / bins`` of the rows at or below it. A value's bin is the number of edges
below it, so ``bin > b`` says the same as ``value > edges[b]``. A missing value (NULL,
NaN) is above all edges, in training, binning and scoring alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlab.operators.quantiles import quantiles

Edges = dict[str, list[float]]


def exact_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> Edges:
    """Edges on the driver: at most ``max_bins - 1`` per feature, whatever the partitions."""
    return quantiles(df, features, max_bins)


def edge_table(df: DataFrame, features: Sequence[str], max_bins: int) -> DataFrame:
    """Edges as rows ``(feature, edge)``."""
    rows = [(f, e) for f, cuts in exact_edges(df, features, max_bins).items() for e in cuts]
    return df.sparkSession.createDataFrame(rows, "feature string, edge double")


def bin_of(value: Column, cuts: Sequence[float]) -> Column:
    """The number of edges strictly below a value; all of them for a missing one."""
    edges = F.array(*[F.lit(float(e)) for e in cuts]).cast("array<double>")
    return F.when(value.isNull(), F.lit(len(cuts))).otherwise(
        F.size(F.filter(edges, lambda edge: edge < value)))


def bin_features(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Add ``bins array<int>``, in the order of ``edges``.

    Edges come from the training rows and may be applied to any other table.
    """
    return df.withColumn("bins", F.array(*[bin_of(F.col(f), c) for f, c in edges.items()]))


def bin_rows(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row per (row, feature number) of ``bins``."""
    return df.select(row_id, F.posexplode("bins").alias("feature", "bin"))
