import hashlib
import math

import pytest
from pyspark.sql import functions as F

from boostlab.functions.rand import literal_uniform
from boostlab.operators import shaping
from boostlab.operators.quantiles import quantiles
from boostlab.sources import generators


@pytest.mark.parametrize("n,share", [(1, 0.05), (7, 0.05), (1000, 0.05), (333, 0.5), (10, 1.0)])
def test_exact_split_takes_the_rounded_up_share(spark, n, share):
    split = shaping.split_exact(generators.row_ids(spark, n, 5), "row_id", share)
    assert split.filter("is_test").count() == math.ceil(round(n * share, 6))


def test_exact_split_counts_equal_ids_apart_from_partitions(spark):
    ids = generators.row_ids(spark, 500, 2)
    one = shaping.split_exact(ids, "row_id", 0.1).filter("is_test").collect()
    two = shaping.split_exact(ids.repartition(9, "row_id"), "row_id", 0.1).filter("is_test").collect()
    assert sorted(one) == sorted(two)


def test_positional_split(spark):
    split = shaping.split_positional(generators.row_ids(spark, 9), "row_id")
    assert [r["is_test"] for r in split.orderBy("row_id").collect()] == [False] * 7 + [True] * 2


def test_short_last_chunk(spark):
    census = shaping.chunk_census(generators.row_ids(spark, 10), "row_id", 3)
    sizes = census.filter("rule = 'per_worker'").orderBy("chunk").collect()
    assert [r["n_rows"] for r in sizes] == [3, 3, 3, 1]


def test_layout_repeats(spark):
    ids = generators.row_ids(spark, 1000, 3)
    census = [
        shaping.lay_out(ids, "row_id", 4).groupBy(F.spark_partition_id().alias("p")).count()
        .orderBy("p").collect() for _ in range(2)
    ]
    assert census[0] == census[1] and len(census[0]) == 4


@pytest.mark.parametrize("mode", ["md5", "fast"])
def test_generated_rows_do_not_depend_on_partitions(spark, mode):
    def rows(partitions):
        ids = generators.row_ids(spark, 300, partitions)
        return sorted(generators.gen_classification(ids, 6, mode=mode).collect())

    assert rows(1) == rows(5)


def test_generated_rows_are_shaped_as_matrices(spark):
    """Values follow the construction, a missing id has none, and no row is gone through by
    SQL lambdas, which no code is generated for."""
    ids = generators.row_ids(spark, 50, 3).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) row_id"))
    made = generators.gen_classification(ids, 7, 4, 2, flip_y=0.0)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    corners = generators.cluster_signs(4, 4, 42)
    blend = generators.mixing(42, "blend", 4, 2)

    def normal(tag, i):
        digest = hashlib.md5(f"42:{tag}:{i}".encode()).hexdigest()
        first, second = int(digest[:8], 16), int(digest[8:16], 16)
        return math.sqrt(-2 * math.log((first + 1) / (2**32 + 1))) * math.cos(
            2 * math.pi * second / 2**32)

    for row in made.collect():
        i = row["row_id"]
        if i is None:
            assert not any(v is not None for v in row)
            continue
        cluster = int(4 * literal_uniform(42, "cluster", i))
        mix = generators.mixing(42, f"mix{cluster}", 4, 4)
        known = [sum(normal(f"z{k}", i) * mix[k][j] for k in range(4)) + corners[cluster][j]
                 for j in range(4)]
        mixed = [sum(known[k] * blend[k][j] for k in range(4)) for j in range(2)]
        want = [*known, *mixed, normal("noise6", i)]
        assert list(row)[1:8] == pytest.approx(want, abs=1e-12)
        assert row["label"] == cluster % 2


def test_generated_classes_are_balanced_and_flipped(spark):
    ids = generators.row_ids(spark, 20000, 4)
    made = generators.gen_classification(ids, 8, mode="fast")
    assert made.columns == ["row_id", *[f"f{i}" for i in range(8)], "label"]
    assert abs(made.agg(F.avg("label")).first()[0] - 0.5) < 0.02
    linear = generators.gen_linear_threshold(ids, 3, mode="fast")
    wrong = linear.filter((F.col("f0") + 0.5 * F.col("f1") > 0).cast("int") != F.col("label"))
    assert 0 < wrong.count() < 1500


def test_generator_rejects_too_many_clusters(spark):
    with pytest.raises(ValueError):
        generators.gen_classification(generators.row_ids(spark, 5), 2, 1, 0)


@pytest.mark.parametrize("partitions", [3, 11])
def test_quantiles_are_exact_on_any_partitions(spark, partitions):
    n = 20_000
    hot = F.when(F.col("id") % 3 == 0, 7.0)  # a third of the rows on one value
    signed = F.exp(F.hash("id") / F.lit(2.0**28)) * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    df = spark.range(0, n, 1, partitions).select(
        hot.otherwise(signed).alias("x"), F.lit(None).cast("double").alias("y"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("z"))
    found = quantiles(df, ["x", "y", "z"], 64)
    assert found["y"] == []
    for name in ("x", "z"):
        ranked = sorted(r[0] for r in df.select(name).dropna().collect())
        expected = {ranked[-(-k * len(ranked) // 64) - 1] for k in range(1, 64)}
        assert found[name] == sorted(expected)


def test_quantiles_of_odd_values(spark):
    rows = [(float(i % 10),) for i in range(100)] + [(float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    assert quantiles(df, ["x"], 5)["x"] == [1.0, 3.0, 5.0, 7.0]
    infinite = float("inf")
    ends = spark.createDataFrame([(-infinite,), (-0.0,), (0.0,), (infinite,)], "x double")
    assert quantiles(ends, ["x"], 4)["x"] == [-infinite, 0.0]
    assert quantiles(df.limit(0), ["x"], 4)["x"] == [] and quantiles(df, [], 4) == {}


def test_cuts_for_balance_leave_no_range_too_large(spark):
    df = spark.range(50_000).select((F.col("id") / 1e9 + 1.0).alias("x"))  # a narrow band
    cuts = quantiles(df, ["x"], 16, balance=True)["x"]
    assert cuts == sorted(cuts)
    places = [0, *(df.filter(F.col("x") < c).count() for c in cuts), 50_000]
    assert max(b - a for a, b in zip(places, places[1:])) <= 3 * 50_000 / 16
