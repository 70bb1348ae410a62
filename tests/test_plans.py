"""Physical plans: pruned scans, pushed filters, no cross joins."""

import re

import __spark_entry__ as contract
import pytest

from boostlab.sources import relations

LAZY = ["accuracy", "logloss", "ensemble_soft", "ensemble_vote", "member_pivot", "truth_join",
        "telemetry_rollup", "telemetry_windows", "telemetry_parse", "speedup_vs_cpu",
        "compare_runs", "chunk_census", "split_hash", "split_positional", "cast_features",
        "gen_classification", "best_of", "matrix_sum"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, sf_dir, name):
    plan = plan_of(contract.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_order_features_reads_only_what_it_needs(spark, sf_dir):
    plan = plan_of(relations.order_features(spark, sf_dir))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    columns = sorted(c.split(":")[0] for s in scans for c in s.split(","))
    assert columns == ["l_discount", "l_orderkey", "l_quantity", "l_tax", "o_orderkey"]
    assert "partial_sum" in plan


def test_split_hash_needs_no_shuffle(spark, sf_dir):
    assert "Exchange" not in plan_of(contract.queries()["split_hash"](spark, sf_dir))


def test_filters_reach_the_scan(spark, sf_dir):
    telemetry = relations.table(spark, sf_dir, "events").filter("value > 100").select("user_id")
    assert "GreaterThan(value,100.0)" in plan_of(telemetry)
