import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boostlab.operators import metrics

SCHEMA = "label int, score double"


def pair_auc(rows):
    """Share of (positive, negative) pairs ranked right, ties one half."""
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def auc(spark, rows):
    return metrics.roc_auc(spark.createDataFrame(rows, SCHEMA)).first()["auc"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12).map(lambda i: i / 12)),
                min_size=2, max_size=60))
def test_auc_is_share_of_ordered_pairs(spark, rows):
    expected = pair_auc(rows)
    found = auc(spark, rows)
    assert found is None if expected is None else found == pytest.approx(expected, abs=1e-12)


def test_auc_with_a_third_of_the_rows_on_one_score(spark):
    rows = [(i % 3 == 0, 0.25 if i % 3 == 1 else (i * 37 % 101) / 101) for i in range(600)]
    rows = [(int(y), s) for y, s in rows]
    assert auc(spark, rows) == pytest.approx(pair_auc(rows), abs=1e-12)


def test_auc_of_many_distinct_scores_in_a_narrow_band(spark):
    rows = [(int(i * 7919 % 13 < 5), 0.5 + 1e-9 * (i * 101 % 997)) for i in range(997)]
    rows += [(1, 0.0), (0, 1.0)]
    assert auc(spark, rows) == pytest.approx(pair_auc(rows), abs=1e-12)


def test_auc_keeps_under_a_rising_map_and_is_half_for_a_constant(spark):
    rows = [(i % 2, math.sin(i)) for i in range(200)]
    rising = [(y, s**3 + 5) for y, s in rows]
    assert auc(spark, rows) == pytest.approx(auc(spark, rising), abs=1e-12)
    assert auc(spark, [(i % 2, 0.7) for i in range(10)]) == 0.5


def test_evaluate_equals_row_by_row_metrics(spark):
    rows = [(int(i % 5 < 2), (i * 13 % 29) / 29) for i in range(290)]
    df = spark.createDataFrame(rows, "label int, proba double")
    found = metrics.evaluate(df).first()
    plain = df.agg(
        metrics.accuracy(F.col("label"), (F.col("proba") > 0.5).cast("int")).alias("accuracy"),
        metrics.logloss(F.col("label"), F.col("proba")).alias("logloss"),
    ).first()
    assert found["n_rows"] == 290
    assert found["accuracy"] == pytest.approx(plain["accuracy"])
    assert found["logloss"] == pytest.approx(plain["logloss"])
    assert found["auc"] == pytest.approx(pair_auc(rows))


def test_rows_are_scored_once(spark):
    """The scoring behind a metric runs once per row, whatever the metric does after."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame([(i % 2, i / 50) for i in range(50)], SCHEMA)
    metrics.evaluate(df.mapInPandas(count, SCHEMA), proba="score").first()
    assert seen.value == 50
