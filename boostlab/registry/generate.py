"""Generated tables, over the ids of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boostlab.registry.base import query
from boostlab.registry.sqlparts import normal, uniform
from boostlab.sources import generators, relations

N_CLUSTERS = 4
SMALL = (8, 4, 2)  # features, informative ones, redundant ones
PUBLISHED = (28, 14, 7)


def _event_ids(spark, sf_dir):
    return relations.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))


def _rounded(df, n_features):
    return df.select(
        "row_id", *[F.round(f"f{j}", 6).alias(f"f{j}") for j in range(n_features)], "label"
    )


def _coefficient(tag: str, index: int) -> str:
    """A generator coefficient in [-1, 1), worked out by the SQL engine."""
    return f"(2.0::DOUBLE * {uniform(42, tag, str(index))} - 1.0::DOUBLE)"


def _classification_sql(n_features: int, n_informative: int, n_redundant: int) -> str:
    """The construction spelled out: corners, mixes, redundant mixes, noise, flips."""
    corners = generators.cluster_signs(N_CLUSTERS, n_informative, 42)
    z = ", ".join(f"{normal(42, f'z{i}', 'row_id')} AS z{i}" for i in range(n_informative))
    mix = ", ".join(
        f"{_coefficient(f'mix{c}', i * n_informative + j)} AS a{c}_{i}_{j}"
        for c in range(N_CLUSTERS) for i in range(n_informative) for j in range(n_informative)
    )
    blend = ", ".join(
        f"{_coefficient('blend', i * n_redundant + k)} AS b{i}_{k}"
        for i in range(n_informative) for k in range(n_redundant)
    )
    placed = ", ".join(
        "CASE cluster " + " ".join(
            f"WHEN {c} THEN " + " + ".join(f"z{i} * a{c}_{i}_{j}" for i in range(n_informative))
            + f" + {corners[c][j]}" for c in range(N_CLUSTERS)
        ) + f" END AS f{j}" for j in range(n_informative)
    )
    mixed = ", ".join(
        "round(" + " + ".join(f"f{i} * b{i}_{k}" for i in range(n_informative))
        + f", 6) AS f{n_informative + k}" for k in range(n_redundant)
    )
    known = ", ".join(f"round(f{j}, 6) AS f{j}" for j in range(n_informative))
    noise = ", ".join(
        f"round({normal(42, f'noise{j}', 'row_id')}, 6) AS f{j}"
        for j in range(n_informative + n_redundant, n_features)
    )
    return f"""WITH coefficients AS (SELECT {mix}, {blend}),
drawn AS (
  SELECT event_id AS row_id, floor({uniform(42, 'cluster', 'event_id')} * {N_CLUSTERS})::INT AS cluster
  FROM events),
normals AS (SELECT row_id, cluster, {z} FROM drawn),
shaped AS (SELECT row_id, cluster, coefficients.*, {placed} FROM normals, coefficients)
SELECT row_id, {known}, {mixed}, {noise},
       CASE WHEN {uniform(42, 'flip', 'row_id')} < 0.01
            THEN ({uniform(42, 'coin', 'row_id')} < 0.5)::INT ELSE cluster % 2 END AS label
FROM shaped"""


def _classification(spark, sf_dir, shape):
    made = generators.gen_classification(_event_ids(spark, sf_dir), *shape)
    return _rounded(made, shape[0])


@query("gen_classification", _classification_sql(*SMALL))
def q_gen_classification(spark, sf_dir):
    return _classification(spark, sf_dir, SMALL)


@query("gen_classification_28", _classification_sql(*PUBLISHED))
def q_gen_classification_28(spark, sf_dir):
    return _classification(spark, sf_dir, PUBLISHED)


@query(
    "gen_linear_threshold",
    f"""WITH drawn AS (
  SELECT event_id AS row_id, {", ".join(f"{normal(42, f'f{j}', 'event_id')} AS f{j}" for j in range(6))},
         {normal(42, 'noise', 'event_id')} AS noise FROM events)
SELECT row_id, {", ".join(f"round(f{j}, 6) AS f{j}" for j in range(6))},
       (f0 + f1 * 0.5::DOUBLE + noise * 0.1::DOUBLE > 0)::INT AS label FROM drawn""",
)
def q_gen_linear_threshold(spark, sf_dir):
    return _rounded(generators.gen_linear_threshold(_event_ids(spark, sf_dir), 6), 6)


@query(
    "gen_uniform",
    f"""SELECT event_id AS row_id,
  {", ".join(f"round({uniform(42, f'f{j}', 'event_id')}, 6) AS f{j}" for j in range(6))},
  ({uniform(42, 'label', 'event_id')} >= 0.5)::INT AS label FROM events""",
)
def q_gen_uniform(spark, sf_dir):
    return _rounded(generators.gen_uniform(_event_ids(spark, sf_dir), 6), 6)


@query(
    "matrix_sum",
    f"""WITH cells AS (
  SELECT o_orderkey AS i, j, {uniform(42, 'cell', 'o_orderkey * 16 + j')} AS x
  FROM orders, range(0, 16) t(j)),
blocks AS (
  SELECT i // 1000 AS block_i, j // 8 AS block_j, count(*) AS n_cells, sum(x) AS total
  FROM cells GROUP BY 1, 2)
SELECT block_i, block_j, sum(n_cells)::BIGINT AS n_cells, round(sum(total), 6) AS total
FROM blocks GROUP BY ROLLUP (block_i, block_j) HAVING grouping(block_i) = grouping(block_j)""",
)
def q_matrix_sum(spark, sf_dir):
    ids = relations.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    blocks = generators.block_sums(generators.gen_matrix(ids, 16, 1000, 8))
    return generators.with_whole(blocks).withColumn("total", F.round("total", 6))
