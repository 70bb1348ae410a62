import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boostlab.operators import binning, boosting, forest, grow, metrics, mllib, model
from boostlab.operators.boosting import BoostParams, binned_rows, boost_binned, boost_watched
from boostlab.sources import generators

N, WIDTH = 500, 4
FEATURES = [f"f{i}" for i in range(WIDTH)]


@pytest.fixture(scope="module")
def train(spark):
    made = generators.gen_classification(generators.row_ids(spark, N, 3), WIDTH, 3, 1, mode="fast")
    return made.persist()


@pytest.fixture(scope="module")
def arrays(train):
    pdf = train.orderBy("row_id").toPandas()
    return pdf[FEATURES].to_numpy(), pdf["label"].to_numpy()


def naive_margins(x, y, edges, params):
    """Boosting by plain loops over rows, features and cuts."""
    bins = np.stack([np.searchsorted(edges[f], x[:, i]) for i, f in enumerate(FEATURES)])
    margin, l2 = np.zeros(len(y)), params.l2

    def term(g, h):
        return g * g / (h + l2) if h + l2 > 0 else 0.0

    def best(rows, g, h):
        found = (0.0, None, None)
        for f in range(WIDTH):
            for b in range(len(edges[FEATURES[f]])):
                left = rows & (bins[f] <= b)
                right = rows & (bins[f] > b)
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()
                if hl < max(params.min_child, 1e-9) or hr < max(params.min_child, 1e-9):
                    continue
                gain = 0.5 * (term(gl, hl) + term(gr, hr) - term(gl + gr, hl + hr))
                gain = np.rint(gain * 1e9) / 1e9
                if gain > found[0]:
                    found = (gain, f, b)
        return found

    for _ in range(params.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = [np.ones(len(y), bool)]
        depth = {0: 0}
        if params.growth == "leaf":
            while len(leaves) < params.num_leaves:
                options = [
                    (best(rows, g, h), i) for i, rows in enumerate(leaves)
                    if depth[i] < params.max_depth
                ]
                options = [(s, i) for s, i in options if s[1] is not None]
                if not options:
                    break
                (_, f, b), i = max(options, key=lambda o: o[0][0])
                rows = leaves[i]
                leaves[i] = rows & (bins[f] <= b)
                leaves.append(rows & (bins[f] > b))
                depth[i] += 1
                depth[len(leaves) - 1] = depth[i]
        else:
            for _ in range(params.max_depth):
                grown = []
                for rows in leaves:
                    _, f, b = best(rows, g, h)
                    grown += [rows] if f is None else [rows & (bins[f] <= b), rows & (bins[f] > b)]
                leaves = grown
        for rows in leaves:
            if rows.any():
                margin[rows] -= params.learning_rate * g[rows].sum() / (h[rows].sum() + l2)
    return margin


@pytest.mark.parametrize("growth,leaves,depth", [("level", None, 3), ("leaf", 5, 4), ("leaf", 6, 3)])
def test_booster_equals_plain_loops(train, arrays, growth, leaves, depth):
    params = boosting.BoostParams(rounds=3, growth=growth, num_leaves=leaves, max_depth=depth,
                                  max_bins=8, learning_rate=0.5)
    fitted = boosting.boost(train, FEATURES, params)
    scored = model.score(train, fitted).orderBy("row_id").toPandas()
    margin = naive_margins(*arrays, fitted.edges, params)
    assert np.allclose(scored["proba"], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_symmetric_trees_share_one_cut_per_level(train):
    fitted = boosting.boost(
        train, FEATURES, boosting.BoostParams(rounds=2, growth="symmetric", max_depth=3, max_bins=8)
    )
    for tree in fitted.trees:
        level, nodes = 0, [0]
        while nodes and tree.feature[nodes[0]] >= 0:
            assert len({(tree.feature[n], tree.cut[n]) for n in nodes}) == 1
            nodes = [c for n in nodes for c in (tree.left[n], tree.right[n])]
            level += 1
        assert level == tree.depth <= 3


def test_loss_falls_every_round_and_plan_stays_short(train):
    params = boosting.BoostParams(rounds=boosting.WRITE_EVERY + 2, max_depth=2, max_bins=8)
    fitted = boosting.boost(train, FEATURES, params)
    history = model.eval_history(train, fitted).orderBy("round").collect()
    losses = [r["logloss"] for r in history]
    assert len(losses) == params.rounds
    assert all(b < a for a, b in zip(losses, losses[1:]))
    last = metrics.evaluate(model.score(train, fitted)).first()["logloss"]
    assert last == pytest.approx(losses[-1])
    best = model.best_round(model.eval_history(train, fitted)).first()
    assert (best["round"], best["logloss"]) == (params.rounds, pytest.approx(min(losses)))


@pytest.mark.parametrize("kind", ["boost", "bootstrap", "subsample", "bagged"])
def test_model_does_not_depend_on_partitions(train, kind):
    def fit(rows):
        if kind == "boost":
            params = boosting.BoostParams(rounds=2, max_depth=3, max_bins=8)
            return boosting.boost(rows, FEATURES, params)
        edges = binning.exact_edges(train, FEATURES, 8)
        data = forest.forest_data(rows, FEATURES, edges=edges)
        try:
            return forest.fit_forest(data, kind, 4, 4)
        finally:
            data.close()

    one, many = fit(train.coalesce(1)), fit(train.repartition(7, "f0"))
    assert [t.feature for t in one.trees] == [t.feature for t in many.trees]
    assert [t.cut for t in one.trees] == [t.cut for t in many.trees]
    for a, b in zip(one.trees, many.trees):
        assert np.allclose(a.value, b.value, atol=1e-9)


def test_growing_in_several_jobs_gives_the_same_trees(train, monkeypatch):
    data = forest.forest_data(train, FEATURES, max_bins=8)
    try:
        whole = forest.fit_forest(data, "subsample", 3, 4)
        monkeypatch.setattr(grow, "MAX_CELLS", 8 * WIDTH * 3)
        parts = forest.fit_forest(data, "subsample", 3, 4)
    finally:
        data.close()
    assert [t.feature for t in whole.trees] == [t.feature for t in parts.trees]


@pytest.mark.parametrize("growth", ["level", "symmetric"])
def test_lanes_and_portions_change_no_tree(train, growth, monkeypatch):
    params = boosting.BoostParams(rounds=2, growth=growth, max_depth=3, max_bins=8, min_rows=5)
    whole = boosting.boost(train, FEATURES, params)
    monkeypatch.setattr(grow, "ONE_STEP", 1)
    monkeypatch.setattr(grow, "SUM_TASK_BYTES", 256)
    monkeypatch.setattr(grow, "MAX_CELLS", 8 * 4 * 2)
    monkeypatch.setattr(grow, "TASK_PAIRS", 100)
    parts = boosting.boost(train.repartition(11), FEATURES, params)
    assert [t.feature for t in whole.trees] == [t.feature for t in parts.trees]
    assert [t.cut for t in whole.trees] == [t.cut for t in parts.trees]
    assert len(whole.trees[0].feature) > 3


def test_data_set_the_number_of_tasks(train):
    assert grow._map_tasks(train, 10**12, 28) == -(-28 * 10**12 // grow.TASK_PAIRS)


def test_forest_kinds_learn_and_keep_their_limits(train):
    data = forest.forest_data(train, FEATURES)
    try:
        for kind, changes in (("bootstrap", {}), ("subsample", {}), ("bagged", {"num_leaves": 6})):
            fitted = forest.fit_forest(data, kind, 12, 5, **changes)
            assert metrics.evaluate(model.score(train, fitted)).first()["auc"] > 0.9
            assert all(t.depth <= 5 for t in fitted.trees)
            assert len({tuple(t.feature) for t in fitted.trees}) > 1
            if changes:
                assert max(t.leaves() for t in fitted.trees) <= 6
    finally:
        data.close()


def test_members_drop_the_remainder_and_one_member_votes_alone(train):
    data = forest.forest_data(train, FEATURES)
    try:
        several = forest.fit_members(data, "bootstrap", 7, 3, 3)
        alone = forest.fit_members(data, "bootstrap", 3, 1, 3)
    finally:
        data.close()
    assert sum(len(m.trees) for m in several) == 6
    voted = forest.score_members(train, alone).select("row_id", "proba")
    direct = model.score(train, alone[0]).select("row_id", F.col("proba").alias("direct"))
    worst = voted.join(direct, "row_id").agg(F.max(F.abs(F.col("proba") - F.col("direct")))).first()
    assert worst[0] == 0.0


def test_model_table_and_both_ways_of_scoring(spark, train, monkeypatch):
    fitted = boosting.boost(train, FEATURES, boosting.BoostParams(rounds=3, max_depth=3, max_bins=8))
    loaded = model.TreeModel.from_table(fitted.to_table(spark), FEATURES)
    by_sql = model.score(train, loaded).orderBy("row_id").toPandas()["proba"]
    monkeypatch.setattr(model, "EXPRESSION_NODES", 0)
    by_batch = model.score(train, fitted).orderBy("row_id").toPandas()["proba"]
    assert np.allclose(by_sql, by_batch, atol=1e-12)


def test_one_class_gives_a_single_leaf(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("f0"),
                                F.lit(1).alias("label"))
    fitted = boosting.boost(df, ["f0"], boosting.BoostParams(rounds=1, max_depth=2, max_bins=4))
    tree = fitted.trees[0]
    assert len(set(np.sign([v for f, v in zip(tree.feature, tree.value) if f < 0]))) == 1
    assert metrics.evaluate(model.score(df, fitted)).first()["accuracy"] == 1.0


def test_exact_edges_are_ranked_values(spark):
    values = [float((i * i) % 37) for i in range(101)] + [5.0] * 60
    df = spark.createDataFrame([(v,) for v in values], "f0 double")
    ranked = sorted(values)
    expected = sorted({ranked[math.ceil(k * len(values) / 7) - 1] for k in range(1, 7)})
    assert binning.exact_edges(df, ["f0"], 7)["f0"] == expected


def test_hashed_uniforms_are_flat():
    u = grow.hashed(42, np.arange(20000))
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.mean(u < 0.8) - 0.8) < 0.01
    weights = grow.row_weights(grow.Growth(bootstrap=True), 7, np.arange(20000))
    assert abs(weights.mean() - 1.0) < 0.03 and abs(np.mean(weights == 0) - math.exp(-1)) < 0.02


def test_missing_values_go_right_everywhere(spark):
    rows = spark.createDataFrame([(0.5,), (2.0,), (None,), (float("nan"),)], "f0 double")
    tree = model.Tree(depth=1)
    left, right = tree.split(0, 0, 0)
    tree.value[left], tree.value[right] = -1.0, 1.0
    for times in (1, 200):  # one feature: an expression, then batches
        fitted = model.TreeModel(["f0"], {"f0": [1.0]}, [tree] * times, mean=True)
        margins = [r[0] for r in rows.select(model.margin_column(fitted)).collect()]
        assert np.allclose(margins, [-1.0, 1.0, 1.0, 1.0])
    bins = [r["bins"] for r in binning.bin_features(rows, {"f0": [1.0, 1.5]}).collect()]
    assert bins == [[0], [2], [2], [2]]


def test_history_of_an_averaged_model(spark):
    rows = spark.createDataFrame([(0.5, 1), (2.0, 1)], "f0 double, label int")
    leaf = model.Tree(value=[0.75])
    fitted = model.TreeModel(["f0"], {"f0": []}, [leaf] * 3, mean=True, link="identity")
    losses = [r["logloss"] for r in model.eval_history(rows, fitted).collect()]
    assert np.allclose(losses, -np.log(0.75))


@pytest.fixture(scope="module")
def two_sets(spark):
    rows = generators.gen_classification(generators.row_ids(spark, 3000), 8, mode="fast")
    data = binned_rows(rows.filter("row_id % 3 > 0"), [f"f{i}" for i in range(8)], max_bins=32)
    test = rows.filter("row_id % 3 = 0")
    watch = binned_rows(test, list(data.edges), edges=data.edges)
    yield data, watch, test
    data.close()
    watch.close()


@pytest.mark.parametrize("growth", ["level", "symmetric", "leaf"])
def test_big_children_are_derived(two_sets, growth, monkeypatch):
    """Half the histograms are summed over the rows, and the trees are the same."""
    data, _, _ = two_sets
    params = BoostParams(rounds=2, growth=growth, max_depth=4, num_leaves=12, learning_rate=0.3)
    made = []
    real = grow.Levels.__init__
    monkeypatch.setattr(
        grow.Levels, "__init__", lambda self, *a, **k: made.append(self) or real(self, *a, **k))
    derived = boost_binned(data, params)
    counts = [c for levels in made for c in levels.summed[1:]]
    assert counts and all(2 * summed == opened for summed, opened in counts)
    monkeypatch.setattr(grow.Levels, "_shares", lambda self, trees, nodes, weight: (nodes, {}))
    summed = boost_binned(data, params)
    for a, b in zip(derived.trees, summed.trees):
        assert (a.feature, a.cut, a.left, a.right) == (b.feature, b.cut, b.left, b.right)
        assert a.value == pytest.approx(b.value, abs=1e-9)


def test_derived_nodes_of_several_trees(two_sets):
    """Bagged trees share their jobs; a pool holds the nodes of all of them."""
    data, _, _ = two_sets
    growth = forest.forest_growth("bagged", 8, 4, data.positive, min_child=5.0)
    together = grow.grow_trees(data.blocks, data.edges, growth, {0: 5, 1: 6, 2: 7}, data.n_rows)
    for t, seed in ((0, 5), (1, 6), (2, 7)):
        alone = grow.grow_trees(data.blocks, data.edges, growth, {0: seed}, data.n_rows)[0]
        assert (alone.feature, alone.cut) == (together[t].feature, together[t].cut)


@pytest.mark.parametrize("growth", ["level", "symmetric", "leaf"])
@pytest.mark.parametrize("bounds", [
    {"DIRECT_CELLS": 0}, {"POOL_CELLS": 0}, {"POOL_CELLS": 0, "MAX_CELLS": 1},
    {"POOL_CELLS": 0, "MAX_CELLS": 8 * 32 * 3}, {"POOL_CELLS": 8 * 32 * 2},
    {"DIRECT_CELLS": 0, "ONE_STEP": 1}])
def test_bounds_change_nothing(two_sets, growth, bounds, monkeypatch):
    """Histograms that are summed first, levels cut in tasks, in portions, in lanes, and
    levels beyond the pool after some within it."""
    data, _, _ = two_sets
    params = BoostParams(rounds=1, growth=growth, max_depth=3, num_leaves=6, learning_rate=0.3)
    whole = boost_binned(data, params).trees[0]
    for name, value in bounds.items():
        monkeypatch.setattr(grow, name, value)
    other = boost_binned(data, params).trees[0]
    assert (other.feature, other.cut) == (whole.feature, whole.cut)
    assert other.value == pytest.approx(whole.value, abs=1e-9)


def test_watched_losses_are_those_of_the_history(two_sets):
    data, watch, test = two_sets
    params = BoostParams(rounds=12, max_depth=2, learning_rate=0.5, from_share=True)
    fit = boost_watched(data, watch, params)
    full = boost_binned(data, params)
    assert len(fit.trees) == 12 and [t.cut for t in fit.trees] == [t.cut for t in full.trees]
    history = {r["round"]: r["logloss"] for r in model.eval_history(test, full).collect()}
    assert fit.losses == pytest.approx([history[r] for r in range(1, 13)], abs=1e-9)
    assert len(fit.model.trees) == 1 + fit.losses.index(min(fit.losses))


def test_patience_ends_a_fit(spark, two_sets):
    data, _, test = two_sets
    wrong = test.withColumn("label", 1 - test["label"])
    watch = binned_rows(wrong, list(data.edges), edges=data.edges)
    none = binned_rows(wrong.limit(0), list(data.edges), edges=data.edges)
    try:
        params = BoostParams(rounds=9, max_depth=2, learning_rate=0.5)
        fit = boost_watched(data, watch, params, patience=2)
        assert len(fit.losses) == 3 and len(fit.model.trees) == 1
        unwatched = boost_watched(data, none, params, patience=2)
        assert len(unwatched.model.trees) == len(unwatched.losses) == 9
        other = {**data.edges, "f0": [0.0]}
        with pytest.raises(ValueError):
            boost_watched(data, replace(watch, edges=other), params)
    finally:
        watch.close()
        none.close()


def test_only_rows_of_open_nodes_are_drawn(monkeypatch):
    """Rows outside the nodes to sum cost no draw, and the sums are those of the drawn rows."""
    from boostlab.functions.rand import literal_uniform

    class Blocks:
        def mapInArrow(self, work, _):
            return work

    ids = np.arange(100, 300)
    bins = np.stack([ids % 2, ids % 3 > 0]).astype(np.uint8)
    batch = pa.RecordBatch.from_pydict({
        "ids": [ids.tobytes()], "label": [np.zeros(200, np.int8).tobytes()],
        "bins": [bins.tobytes()], "margin": [np.zeros(200).tobytes()]})
    tree = model.Tree()
    left, _ = tree.split(0, 0, 0)
    tree.depth = 1
    asked, weights = [], grow.row_weights

    def watched(growth, seed, some):
        asked.extend(some.tolist())
        return weights(growth, seed, some)

    monkeypatch.setattr(grow, "row_weights", watched)
    work = grow.level_sums(
        Blocks(), {"a": [0.5], "b": [0.5]}, grow.Growth(row_share=0.4, draws="md5"), {0: tree},
        {0: 7}, {0: [left]})
    (sums,) = work(iter([batch]))
    assert asked == [i for i in ids.tolist() if i % 2 == 0]
    used = [i for i in asked if literal_uniform(7, "rows", i) < 0.4]
    got = np.frombuffer(sums["h"][1].as_py())
    assert got.tolist() == [0.25 * sum(i % 3 == 0 for i in used), 0.25 * sum(i % 3 > 0 for i in used)]


def test_kept_halves_are_split_once(spark, sf_dir):
    from boostlab.registry import trees

    for half in trees._halves(spark, sf_dir):
        assert "md5" not in half._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_of_a_library_fit_are_small(spark):
    """They follow the rows, far below what a task may read."""
    rows = spark.range(0, 2_000_000, 1, 4).selectExpr("id AS row_id", "rand(1) AS f0",
                                                    "0 AS label", "rand(2) AS f1")
    ready = mllib.fit_ready(rows, ["f0", "f1"], "row_id")
    try:
        sizes = ready.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 2_000_000
        assert max(r["count"] for r in sizes) * 32 < 48 << 20
    finally:
        ready.unpersist()
