"""Casts, splits, chunks and bins over the order features."""

from __future__ import annotations

from pyspark.sql import functions as F

from boostlab.functions import scalars
from boostlab.operators import binning, shaping
from boostlab.registry.base import query
from boostlab.registry.sqlparts import ORDER_FEATURES, SIZES, ordered_edges, uniform, word
from boostlab.session import settled
from boostlab.sources import relations

FEATURES = relations.ORDER_FEATURES
BINS = 16

EDGES_SQL = " UNION ALL ".join(ordered_edges(f, "train", BINS) for f in FEATURES)
BINNED_SQL = f"""{ORDER_FEATURES}, edges AS ({EDGES_SQL}),
long AS ({" UNION ALL ".join(
    f"SELECT row_id, label, {i} AS feature, '{f}' AS name, {f}::DOUBLE AS value FROM train"
    for i, f in enumerate(FEATURES))}),
cuts AS (SELECT feature AS name, list(edge) AS cuts FROM edges GROUP BY feature),
binned AS (
  SELECT row_id, label, feature, len(list_filter(cuts, lambda e: e < value))::INT AS bin
  FROM long JOIN cuts USING (name))"""


@query(
    "cast_features",
    f"""WITH {ORDER_FEATURES}
SELECT row_id, f0::FLOAT AS f0, f1::FLOAT AS f1, f2::FLOAT AS f2, f3::FLOAT AS f3, label FROM train""",
)
def q_cast_features(spark, sf_dir):
    return shaping.cast_features(relations.order_features(spark, sf_dir), FEATURES)


@query(
    "split_random_exact",
    f"""WITH keyed AS (SELECT o_orderkey AS row_id, {word(42, 'split', 'o_orderkey')} AS w FROM orders),
ranked AS (SELECT row_id, row_number() OVER (ORDER BY w, row_id) AS rn, count(*) OVER () AS n FROM keyed)
SELECT row_id, rn <= ceil(n * 0.05::DOUBLE) AS is_test FROM ranked""",
)
def q_split_random_exact(spark, sf_dir):
    ids = relations.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return shaping.split_exact(ids, "row_id", 0.05)


@query(
    "split_hash",
    f"""SELECT o_orderkey AS row_id, {uniform(42, 'split', 'o_orderkey')} < 0.05::DOUBLE AS is_test
FROM orders""",
)
def q_split_hash(spark, sf_dir):
    ids = relations.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return shaping.split_hash(ids, "row_id", 0.05)


@query(
    "split_positional",
    """SELECT o_orderkey AS row_id, o_orderkey >= floor((SELECT count(*) FROM orders) * 0.8::DOUBLE) AS is_test
FROM orders""",
)
def q_split_positional(spark, sf_dir):
    ids = relations.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return shaping.split_positional(ids, "row_id")


@query(
    "chunk_census",
    """WITH n AS (SELECT count(*) AS n FROM events), rules AS (
  SELECT 'per_worker' AS rule, n // 7 AS size FROM n
  UNION ALL SELECT 'half_worker_min1', greatest(1, n // 14) FROM n
  UNION ALL SELECT 'half_worker', n // 14 FROM n
  UNION ALL SELECT 'quarter_worker', greatest(n // 28, 10000) FROM n
  UNION ALL SELECT 'fixed', 25000)
SELECT rule, event_id // size AS chunk, count(*) AS n_rows FROM events, rules GROUP BY ALL""",
)
def q_chunk_census(spark, sf_dir):
    ids = relations.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))
    return shaping.chunk_census(ids, "row_id", 7)


@query("quantile_edges", f"WITH {ORDER_FEATURES}, edges AS ({EDGES_SQL}) SELECT * FROM edges")
def q_quantile_edges(spark, sf_dir):
    train = settled(relations.order_features(spark, sf_dir).select(*FEATURES))
    return binning.edge_table(train, FEATURES, BINS)


@query("bin_features", f"WITH {BINNED_SQL} SELECT row_id, feature, bin FROM binned")
def q_bin_features(spark, sf_dir):
    train = settled(relations.order_features(spark, sf_dir))
    edges = binning.exact_edges(train, FEATURES, BINS)
    return binning.bin_rows(binning.bin_features(train, edges))


@query(
    "data_size",
    f"WITH {SIZES} SELECT name, n_samples, round(n_samples * n_features * 4 / 1e6, 6) AS megabytes FROM sizes",
)
def q_data_size(spark, sf_dir):
    sizes = relations.bench_sizes(spark, sf_dir)
    size = shaping.megabytes(F.col("n_samples"), F.col("n_features"))
    return sizes.select("name", "n_samples", F.round(size, 6).alias("megabytes"))


@query("partition_census")
def q_partition_census(spark, sf_dir):
    """Rows and id span of every partition of the laid-out table: of 2,000 rows each where
    that makes a few, of some 128 MB of ids each in a large table."""
    ids = relations.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    n_rows = ids.count()
    partitions = max(1, min(64, -(-n_rows // 2000)), -(-n_rows * 8 // (128 << 20)))
    return (
        shaping.lay_out(ids, "row_id", partitions)
        .groupBy(F.spark_partition_id().alias("partition"))
        .agg(
            F.count("*").alias("n_rows"),
            F.min("row_id").alias("first_id"),
            F.max("row_id").alias("last_id"),
        )
    )


@query(
    "scalar_suite",
    """WITH runs AS (
  SELECT o_orderkey, o_orderdate, (o_orderkey % 12)::INT AS depth, o_totalprice,
         lower(substr(o_orderpriority, 3)) || '_' || CASE o_orderstatus WHEN 'F' THEN 'cpu' ELSE '1gpu' END
           AS name FROM orders)
SELECT o_orderkey, split_part(name, '_', 1) AS lib, contains(name, 'cpu') AS is_cpu,
       round(o_totalprice / 7001, 2) AS r2, (2 ** depth)::INT AS leaves, depth + 1 AS xgb_depth,
       depth + 5 AS lgb_depth, o_orderkey // nullif(depth, 0) AS per_depth,
       greatest(o_orderkey // 8, 10000) AS chunk,
       CASE WHEN o_totalprice / 3000 > 80 THEN 'Excellent scaling'
            WHEN o_totalprice / 3000 > 50 THEN 'Good scaling'
            WHEN o_totalprice / 3000 > 25 THEN 'Limited by single-machine parallelism'
            ELSE 'Overhead dominates' END AS note,
       strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS iso,
       round(1 / (1 + exp(-(o_totalprice / 100000 - 2))), 9) AS proba,
       CASE WHEN name LIKE '%cpu%' THEN '-' ELSE printf('%.0fx', floor(o_totalprice / 1000)) END AS speedup
FROM runs""",
)
def q_scalar_suite(spark, sf_dir):
    price, depth, name = F.col("o_totalprice"), F.col("depth"), F.col("name")
    status = F.when(F.col("o_orderstatus") == "F", "cpu").otherwise("1gpu")
    lib = F.lower(F.substring("o_orderpriority", 3, 20))
    run = relations.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice",
        (F.col("o_orderkey") % 12).cast("int").alias("depth"),
        F.concat_ws("_", lib, status).alias("name"),
    )
    shown = F.when(~scalars.is_cpu(name), F.floor(price / 1000).cast("double"))
    return run.select(
        "o_orderkey",
        scalars.library(name).alias("lib"),
        scalars.is_cpu(name).alias("is_cpu"),
        F.round(price / 7001, 2).alias("r2"),
        scalars.leaves_of_depth(depth).alias("leaves"),
        (depth + 1).alias("xgb_depth"),
        (depth + 5).alias("lgb_depth"),
        scalars.int_div(F.col("o_orderkey"), depth).alias("per_depth"),
        F.greatest(scalars.int_div(F.col("o_orderkey"), F.lit(8)), F.lit(10000).cast("bigint")).alias("chunk"),
        scalars.efficiency_note(price / 3000).alias("note"),
        scalars.file_stamp(F.col("o_orderdate")).alias("stamp"),
        scalars.iso_time(F.col("o_orderdate")).alias("iso"),
        F.round(scalars.logistic(price / 100000 - 2), 9).alias("proba"),
        scalars.speedup_text(shown, 0).alias("speedup"),
    )
