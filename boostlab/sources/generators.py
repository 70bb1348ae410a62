"""Synthetic classification tables over a DataFrame of row ids.

``spark.range(n)`` gives the ids of a table of any size; every value is then
computed where its row lives, from (seed, column, id) alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boostlab.functions.rand import (
    draws, drawn, literal_uniform, normal, normals, uniform, uniforms,
)


def row_ids(spark: SparkSession, n_rows: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n_rows, 1, partitions).withColumnRenamed("id", "row_id")


def informative_of(n_features: int) -> int:
    return max(2, n_features // 2)


def redundant_of(n_features: int) -> int:
    return n_features // 4


def cluster_signs(n_clusters: int, n_informative: int, seed: int) -> list[list[int]]:
    """A distinct corner of the hypercube, as signs, for every cluster."""
    corners: list[list[int]] = []
    draw = 0
    while len(corners) < n_clusters:
        corner = [
            1 if literal_uniform(seed, f"corner{draw}", i) < 0.5 else -1
            for i in range(n_informative)
        ]
        if corner not in corners:
            corners.append(corner)
        draw += 1
    return corners


def mixing(seed: int, tag: str, rows: int, columns: int) -> list[list[float]]:
    """A matrix of coefficients uniform in [-1, 1)."""
    return [
        [2.0 * literal_uniform(seed, tag, r * columns + c) - 1.0 for c in range(columns)]
        for r in range(rows)
    ]


def _products(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products of vectors ``[row, i]`` with a matrix ``[i, j]``, terms added in order of i."""
    total = np.zeros((len(vectors), rows.shape[1]))
    for i in range(len(rows)):
        total += vectors[:, i, None] * rows[i]
    return total


def gen_classification(
    ids: DataFrame,
    n_features: int,
    n_informative: int | None = None,
    n_redundant: int | None = None,
    clusters_per_class: int = 2,
    flip_y: float = 0.01,
    seed: int = 42,
    mode: str = "md5",
) -> DataFrame:
    """Two classes of Gaussian clusters: ``row_id, f0.., label``.

    Clusters sit on corners of a hypercube and each has its own linear mix of
    normals. Redundant features mix the informative ones, the rest is noise,
    and a share ``flip_y`` of the labels is a fresh coin.
    """
    informative = informative_of(n_features) if n_informative is None else n_informative
    redundant = redundant_of(n_features) if n_redundant is None else n_redundant
    clusters = 2 * clusters_per_class
    if informative + redundant > n_features or clusters > 2**informative:
        raise ValueError("more clusters or structured features than the table can hold")
    corners = np.array(cluster_signs(clusters, informative, seed), dtype=float)
    mixes = [np.array(mixing(seed, f"mix{c}", informative, informative)) for c in range(clusters)]
    blend = np.array(mixing(seed, "blend", informative, redundant)).reshape(informative, redundant)
    # Spark draws the words, and batches of rows are shaped as matrices.
    tags = [
        *(f"z{i}" for i in range(informative)),
        *(f"noise{j}" for j in range(informative + redundant, n_features)),
        "cluster", "flip", "coin",
    ]

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = drawn(batch["draws"], len(tags))
            values = normals(words[:, :-3])
            z, noise = values[:, :informative], values[:, informative:]
            of_cluster, of_flip, of_coin = uniforms(words[:, -3:]).T
            cluster = np.floor(of_cluster * clusters).astype(np.int32)
            known = np.empty((len(z), informative))
            for c in range(clusters):
                own = cluster == c
                known[own] = _products(z[own], mixes[c]) + corners[c]
            label = np.where(of_flip < flip_y, of_coin < 0.5, cluster % 2)
            missing = batch["draws"].is_null().to_numpy(zero_copy_only=False)
            columns = [*known.T, *_products(known, blend).T, *noise.T]
            yield pa.RecordBatch.from_arrays(
                [batch["row_id"],
                 *(pa.array(np.ascontiguousarray(c), pa.float64(), missing) for c in columns),
                 pa.array(label.astype(np.int32), pa.int32(), missing)],
                names=schema.names,
            )

    needed = ids.select("row_id", draws(seed, tags, F.col("row_id"), mode).alias("draws"))
    schema = T.StructType([
        needed.schema["row_id"],
        *(T.StructField(f"f{j}", T.DoubleType()) for j in range(n_features)),
        T.StructField("label", T.IntegerType()),
    ])
    return needed.mapInArrow(shape, schema)


def gen_linear_threshold(
    ids: DataFrame, n_features: int, seed: int = 42, mode: str = "md5"
) -> DataFrame:
    """Standard normal features; label 1 where ``f0 + 0.5 f1 + 0.1 noise > 0``."""
    row = F.col("row_id")
    drawn = ids.select(
        row,
        *[normal(seed, f"f{j}", row, mode).alias(f"f{j}") for j in range(n_features)],
        normal(seed, "noise", row, mode).alias("noise"),
    )
    signal = F.col("f0") + F.col("f1") * 0.5 + F.col("noise") * 0.1
    return drawn.withColumn("label", (signal > 0).cast("int")).drop("noise")


def gen_uniform(ids: DataFrame, n_features: int, seed: int = 42, mode: str = "md5") -> DataFrame:
    """Uniform features in [0, 1) and a coin-flip label."""
    row = F.col("row_id")
    return ids.select(
        row,
        *[uniform(seed, f"f{j}", row, mode).alias(f"f{j}") for j in range(n_features)],
        (uniform(seed, "label", row, mode) >= 0.5).cast("int").alias("label"),
    )


def gen_matrix(
    ids: DataFrame, width: int, block_rows: int, block_columns: int, seed: int = 42,
    mode: str = "md5",
) -> DataFrame:
    """Uniform matrix cells with their block: ``i, j, block_i, block_j, x``."""
    cells = ids.select(
        F.col("row_id").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))).alias("j"),
    )
    return cells.select(
        "i",
        "j",
        F.floor(F.col("i") / block_rows).cast("bigint").alias("block_i"),
        F.floor(F.col("j") / block_columns).cast("bigint").alias("block_j"),
        uniform(seed, "cell", F.col("i") * width + F.col("j"), mode).alias("x"),
    )


def block_sums(cells: DataFrame) -> DataFrame:
    """Cells and sum of every block; their total is the sum of the matrix."""
    return cells.groupBy("block_i", "block_j").agg(
        F.count("*").alias("n_cells"), F.sum("x").alias("total")
    )


def with_whole(blocks: DataFrame) -> DataFrame:
    """The blocks and, with null coordinates, the whole matrix, from the block rows alone."""
    place = F.col("place")
    return (
        blocks.withColumn("place", F.explode(F.array(
            F.struct("block_i", "block_j"),
            F.struct(*[F.lit(None).cast("bigint").alias(c) for c in ("block_i", "block_j")]))))
        .groupBy(place["block_i"].alias("block_i"), place["block_j"].alias("block_j"))
        .agg(F.sum("n_cells").alias("n_cells"), F.sum("total").alias("total"))
    )
