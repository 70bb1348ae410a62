"""Training, scoring and sweeps over the order features."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.operators import (
    binning, estimator, forest, grow, metrics, mllib, model, shaping,
)
from boostlab.operators.boosting import (
    BoostParams, binned_rows, boost, boost_binned, boost_watched,
)
from boostlab.plans import reports, sweep
from boostlab.registry.base import query, report
from boostlab.registry.shape import BINNED_SQL, BINS, FEATURES
from boostlab.registry.sqlparts import ORDER_FEATURES, uniform
from boostlab.registry.treesql import (
    NODES, boost_sql, forest_sql, quality_sql, voted_quality_sql,
)
from boostlab.session import run_dir, settled
from boostlab.sources import relations, results

ETA = 0.3
# Rows of a fit on part of them; the others are those split off by hash.
_TRAIN = f"{uniform(42, 'split', 'row_id')} >= 0.2::DOUBLE"


def _params(**settings) -> BoostParams:
    return BoostParams(learning_rate=ETA, max_bins=BINS, **settings)


def _rows(spark, sf_dir):
    """The training rows, made once: edges, fits and scoring all read them again."""
    return settled(relations.order_features(spark, sf_dir))


def _fitted(spark, sf_dir, **settings):
    """The training rows and a model of them."""
    train = _rows(spark, sf_dir)
    return train, boost(train, FEATURES, _params(**settings))


def _nodes(spark, sf_dir, **settings):
    _, fitted = _fitted(spark, sf_dir, **settings)
    return fitted.to_paths(spark).withColumn("leaf", F.round("leaf", 6))


# Four nodes by bins of two features, and the margins of their rows.
_CUTS, _MARGINS = ((0, 3), (3, 2)), (-0.3, 0.2, 0.5, -0.1)
_GRADIENT_SQL = f"""WITH {BINNED_SQL}, placed AS (
  SELECT row_id, (max(bin) FILTER (feature = 0) > 3)::INT * 2
                 + (max(bin) FILTER (feature = 3) > 2)::INT AS place
  FROM binned GROUP BY row_id),
graded AS (
  SELECT row_id, place + 3 AS node, p - label AS g, p * (1 - p) AS h
  FROM (SELECT row_id, label, place,
               1 / (1 + exp(-([{", ".join(map(str, _MARGINS))}]::DOUBLE[])[place + 1])) AS p
        FROM train JOIN placed USING (row_id))),
cells AS (
  SELECT node, feature, bin, sum(g) AS g, sum(h) AS h, count(*) AS n
  FROM graded JOIN binned USING (row_id) GROUP BY ALL)"""


def _on_four_nodes(spark, sf_dir, work):
    """What ``work`` makes of binned rows, a tree with four open nodes and their numbers.
    It is settled, so the bins can be dropped."""
    data = binned_rows(_rows(spark, sf_dir), FEATURES, max_bins=BINS)
    try:
        tree = model.Tree(depth=2)
        (first, first_cut), (second, second_cut) = _CUTS
        for node in tree.split(0, first, first_cut):
            tree.split(node, second, second_cut)
        tree.value[3:] = _MARGINS
        blocks = grow.add_margin(data.blocks.drop("ids"), tree, data.edges)
        return settled(work(blocks, data.edges, {0: tree}, {0: [3, 4, 5, 6]}))
    finally:
        data.close()


@query("grad_histogram", f"""{_GRADIENT_SQL}
SELECT node, feature, bin, round(g, 6) AS g, round(h, 6) AS h, n FROM cells""")
@report
def q_grad_histogram(spark, sf_dir):
    """The trainer's histograms of a level."""
    growth = grow.Growth(min_rows=1)  # keeps counts

    def work(blocks, edges, trees, open_nodes):
        return grow.cell_rows(
            grow.level_sums(grow.needed_of(blocks, growth), edges, growth, trees, {0: 0},
                            open_nodes), growth)

    cells = _on_four_nodes(spark, sf_dir, work).filter("n > 0")
    return cells.select("node", "feature", "bin", F.round("g", 6).alias("g"),
                        F.round("h", 6).alias("h"), F.col("n").cast("long").alias("n"))


@query("best_split", f"""{_GRADIENT_SQL}, sides AS (
  SELECT node, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl,
         sum(g) OVER v AS gt, sum(h) OVER v AS ht
  FROM cells WINDOW w AS (PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING),
                    v AS (PARTITION BY node, feature)),
gains AS (SELECT *, 0.5::DOUBLE * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1)
                                   - gt * gt / (ht + 1)) AS gain FROM sides)
SELECT node, feature, bin, round(gain, 6) AS gain, round(gl, 6) AS gl, round(hl, 6) AS hl
FROM gains WHERE hl >= 1 AND ht - hl >= 1
QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, feature, bin) = 1""")
@report
def q_best_split(spark, sf_dir):
    """The splits the trainer picks for a level."""
    def work(blocks, edges, trees, open_nodes):
        found = grow.Levels(blocks, edges, grow.Growth(), {0: 0}).find(trees, open_nodes)
        rows = [(node, s.feature, s.bin, s.gain, s.gl, s.hl) for (_, node), s in found.items()]
        return spark.createDataFrame(
            rows, "node int, feature int, bin int, gain double, gl double, hl double")

    return _on_four_nodes(spark, sf_dir, work).select(
        "node", "feature", "bin", *[F.round(c, 6).alias(c) for c in ("gain", "gl", "hl")]
    )


@query("boost_stump", boost_sql(NODES, rounds=1, depth=1))
@report
def q_boost_stump(spark, sf_dir):
    return _nodes(spark, sf_dir, rounds=1, max_depth=1)


@query("boost_level_d2", boost_sql(NODES, rounds=1, depth=2))
@report
def q_boost_level_d2(spark, sf_dir):
    return _nodes(spark, sf_dir, rounds=1, max_depth=2)


@query("boost_symmetric_d2", boost_sql(NODES, rounds=1, depth=2, policy="symmetric"))
@report
def q_boost_symmetric_d2(spark, sf_dir):
    return _nodes(spark, sf_dir, rounds=1, max_depth=2, growth="symmetric")


@query("boost_level", boost_sql(NODES, rounds=3, depth=3))
@report
def q_boost_level(spark, sf_dir):
    return _nodes(spark, sf_dir, rounds=3, max_depth=3)


@query("boost_symmetric", boost_sql(NODES, rounds=3, depth=2, policy="symmetric"))
@report
def q_boost_symmetric(spark, sf_dir):
    return _nodes(spark, sf_dir, rounds=3, max_depth=2, growth="symmetric")


@query("boost_leaf", boost_sql(NODES, rounds=3, depth=2, policy="leaf", num_leaves=3))
@report
def q_boost_leaf(spark, sf_dir):
    return _nodes(spark, sf_dir, rounds=3, max_depth=2, growth="leaf", num_leaves=3)


@query("boost_leaf_min_rows", boost_sql(
    NODES, rounds=2, depth=2, policy="leaf", num_leaves=3, min_rows=1500))
@report
def q_boost_leaf_min_rows(spark, sf_dir):
    """Leaf-wise trees whose leaves hold a least number of rows, here a large one."""
    return _nodes(spark, sf_dir, rounds=2, max_depth=2, growth="leaf", num_leaves=3,
                  min_rows=1500)


@query("boost_base", boost_sql(
    "SELECT tree, path, feature, threshold, round(leaf, 6) AS leaf FROM nodes", rounds=2, depth=2,
    start="(SELECT ln(avg(label) / (1 - avg(label))) FROM train)"))
@report
def q_boost_base(spark, sf_dir):
    """Boosting that starts at the share of class 1."""
    return _nodes(spark, sf_dir, rounds=2, max_depth=2, from_share=True)


@query("score_stump", boost_sql(
    "SELECT row_id, round(1 / (1 + exp(-margin)), 6) AS proba, "
    "(1 / (1 + exp(-margin)) > 0.5)::INT AS prediction FROM m1", rounds=1, depth=1))
def q_score_stump(spark, sf_dir):
    train, fitted = _fitted(spark, sf_dir, rounds=1, max_depth=1)
    scored = model.score(train, fitted)
    return scored.select("row_id", F.round("proba", 6).alias("proba"), "prediction")


@query("score_table", boost_sql(
    "SELECT row_id, round(1 / (1 + exp(-margin)), 6) AS proba, "
    "(1 / (1 + exp(-margin)) > 0.5)::INT AS prediction FROM m2", rounds=2, depth=3))
def q_score_table(spark, sf_dir):
    """Rows scored with a model that went through its node table and back."""
    train, fitted = _fitted(spark, sf_dir, rounds=2, max_depth=3)
    loaded = model.TreeModel.from_table(fitted.to_table(spark), FEATURES)
    scored = model.score(train, loaded)
    return scored.select("row_id", F.round("proba", 6).alias("proba"), "prediction")


_STUMPS = (("f0", 2.0, -0.3, 0.2), ("f1", 90.0, -0.1, 0.4), ("f3", 0.05, 0.25, -0.15))


def _stumps(times: int) -> model.TreeModel:
    """The stumps above, each taken ``times`` times at a share of its leaves."""
    edges: binning.Edges = {f: [] for f in FEATURES} | {f: [cut] for f, cut, _, _ in _STUMPS}
    trees = []
    for _ in range(times):
        for feature, _, low, high in _STUMPS:
            tree = model.Tree(depth=1)
            left, right = tree.split(0, FEATURES.index(feature), 0)
            tree.value[left], tree.value[right] = low / times, high / times
            trees.append(tree)
    return model.TreeModel(FEATURES, edges, trees, base=-0.1)


@query("score_missing", f"""WITH {ORDER_FEATURES}, sparse AS (
  SELECT row_id, nullif(f0, 0) AS f0, CASE WHEN f0 > 0 THEN f1 END AS f1,
         CASE WHEN f0 > 0 THEN f3 END AS f3 FROM train),
scored AS (SELECT row_id, round(1 / (1 + exp(-(-0.1 {" ".join(
    f"+ CASE WHEN {f} <= {cut} THEN {low} ELSE {high} END" for f, cut, low, high in _STUMPS
)})::DOUBLE)), 6) AS proba FROM sparse)
SELECT row_id, kind, proba FROM scored, (VALUES ('large'), ('small')) AS kinds(kind)""")
def q_score_missing(spark, sf_dir):
    """Orders without lines have no features: missing values go to the right in the
    expression of a small model and in the batches of a large one alike."""
    rows = relations.order_features(spark, sf_dir)
    some = rows.select("row_id", *[
        F.when(F.col("f0") > 0, F.col(f)).alias(f) for f in FEATURES])
    return model.score(some, _stumps(1)).select(
        "row_id", F.lit("small").alias("kind"), F.round("proba", 6).alias("proba")
    ).unionByName(model.score(some, _stumps(30)).select(
        "row_id", F.lit("large").alias("kind"), F.round("proba", 6).alias("proba")))


@query("eval_history", boost_sql(" UNION ALL ".join(
    f"SELECT {r} AS round, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS logloss "
    f"FROM (SELECT label, 1 / (1 + exp(-margin)) AS p FROM m{r})" for r in (1, 2, 3)),
    rounds=3, depth=2))
@report
def q_eval_history(spark, sf_dir):
    train, fitted = _fitted(spark, sf_dir, rounds=3, max_depth=2)
    return model.eval_history(train, fitted).withColumn("logloss", F.round("logloss", 6))


_FLIPPED = "CASE WHEN row_id % 6 = 0 THEN 1 - label ELSE label END"
_ROUNDS, _PATIENCE = 9, 2


@query("boost_early_stop", boost_sql(f"""SELECT round, logloss, round <= best AS kept, leaf_sum
FROM (SELECT *, min(stop) OVER () AS last,
             arg_min(round, CASE WHEN round <= stop THEN exact END) OVER () AS best
      FROM (SELECT *, coalesce(min(CASE WHEN round - least_at >= {_PATIENCE} THEN round END) OVER (),
                               {_ROUNDS}) AS stop
            FROM (SELECT *, arg_min(round, exact) OVER (
                    ORDER BY round ROWS UNBOUNDED PRECEDING) AS least_at
                  FROM ({" UNION ALL ".join(
    f"SELECT {r} AS round, avg(-(l * ln(p) + (1 - l) * ln(1 - p))) AS exact, "
    f"round(avg(-(l * ln(p) + (1 - l) * ln(1 - p))), 6) AS logloss, "
    f"(SELECT round(sum(leaf), 6) FROM nodes WHERE tree = {r - 1}) AS leaf_sum "
    f"FROM (SELECT {_FLIPPED} AS l, 1 / (1 + exp(-margin)) AS p FROM m{r})"
    for r in range(1, _ROUNDS + 1))}))))
WHERE round <= last""", rounds=_ROUNDS, depth=2))
@report
def q_boost_early_stop(spark, sf_dir):
    """A fit watched on rows a sixth of whose labels are wrong: it ends when their loss has
    not gone down for some rounds, and keeps the trees of the best round."""
    rows = _rows(spark, sf_dir)
    data = binned_rows(rows, FEATURES, max_bins=BINS)
    watch = binned_rows(rows.withColumn("label", F.expr(_FLIPPED)), FEATURES, edges=data.edges)
    try:
        fit = boost_watched(data, watch, _params(rounds=_ROUNDS, max_depth=2), _PATIENCE)
    finally:
        data.close()
        watch.close()
    sums = [sum(v for v, f in zip(t.value, t.feature) if f < 0) for t in fit.trees]
    made = [(r, loss, r <= len(fit.model.trees), total)
            for r, (loss, total) in enumerate(zip(fit.losses, sums), start=1)]
    return spark.createDataFrame(
        made, "round int, logloss double, kept boolean, leaf_sum double").select(
        "round", F.round("logloss", 6).alias("logloss"), "kept",
        F.round("leaf_sum", 6).alias("leaf_sum"))


@query("best_round", """SELECT user_id, event_id AS round, value AS logloss FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1""")
def q_best_round(spark, sf_dir):
    """The best round of every user's history of rounds and losses."""
    history = relations.table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("round"), F.col("value").alias("logloss")
    )
    return model.best_round(history, ("user_id",))


def _halves(spark, sf_dir):
    """Training and test rows of the order features, by hash. The rows are kept with their
    side, as every fit and every scoring reads them again."""
    split = settled(shaping.split_hash(relations.order_features(spark, sf_dir), "row_id", 0.2))
    return (split.filter(~F.col("is_test")).drop("is_test"),
            split.filter("is_test").drop("is_test"))


@report
def held_out_quality(spark, sf_dir):
    """How well does a boosted model rank rows it has not seen?"""
    train, test = _halves(spark, sf_dir)
    fitted = boost(train, FEATURES, _params(rounds=5, max_depth=4))
    return metrics.evaluate(model.score(test, fitted))


def _rounded(quality):
    return quality.select("n_rows", *[
        F.round(c, 9).alias(c) for c in ("accuracy", "logloss", "auc")])


@query("held_out_quality", boost_sql(quality_sql("m5", _TRAIN), rounds=5, depth=4, used=_TRAIN))
def q_held_out_quality(spark, sf_dir):
    return _rounded(held_out_quality(spark, sf_dir))


@query("boost_wide")
@report
def q_boost_wide(spark, sf_dir):
    """Leaf-wise boosting of all embedding elements, judged on the same rows."""
    rows = settled(relations.wide_embeddings(spark, sf_dir))
    features = [c for c in rows.columns if c.startswith("f")]
    params = BoostParams(rounds=3, growth="leaf", num_leaves=8, max_depth=4, learning_rate=ETA)
    return metrics.evaluate(model.score(rows, boost(rows, features, params)))


@query("gbt_mllib")
@report
def q_gbt_mllib(spark, sf_dir):
    """MLlib boosting: log loss of the test rows after every round."""
    train, test = _halves(spark, sf_dir)
    ready = mllib.fit_ready(train, FEATURES, "row_id")
    try:
        fitted = mllib.gbt(max_iter=5, max_depth=4, step=0.3).fit(ready)
    finally:
        ready.unpersist()
    losses = mllib.round_losses(fitted, mllib.assembled(test, FEATURES))
    return spark.createDataFrame(
        [(i, float(v)) for i, v in enumerate(losses, start=1)], "round int, logloss double"
    )


def _mllib_forest(spark, sf_dir, **settings):
    train, test = _halves(spark, sf_dir)
    ready = mllib.fit_ready(train, FEATURES, "row_id")
    try:
        fitted = mllib.detached(mllib.forest(20, 5, **settings).fit(ready))
    finally:
        ready.unpersist()
    return metrics.evaluate(mllib.scored(mllib.assembled(test, FEATURES), fitted))


@query("rf_mllib")
@report
def q_rf_mllib(spark, sf_dir):
    return _mllib_forest(spark, sf_dir)


def _forest_quality(spark, sf_dir, kind, n_trees, depth):
    train, test = _halves(spark, sf_dir)
    data = forest.forest_data(train, FEATURES)
    try:
        fitted = forest.fit_forest(data, kind, n_trees, depth)
    finally:
        data.close()
    return metrics.evaluate(model.score(test, fitted))


@query("rf_bootstrap")
@report
def q_rf_bootstrap(spark, sf_dir):
    return _forest_quality(spark, sf_dir, "bootstrap", 20, 5)


@query("rf_subsample")
@report
def q_rf_subsample(spark, sf_dir):
    return _forest_quality(spark, sf_dir, "subsample", 20, 6)


@query("rf_bagged")
@report
def q_rf_bagged(spark, sf_dir):
    return _forest_quality(spark, sf_dir, "bagged", 20, 8)


# Kinds of forest, checked node by node: draws by md5, two trees of two levels.
CHECKED = {"bootstrap": {}, "subsample": {}, "bagged": {"num_leaves": 3}}


def _checked_growth(kind: str, positive: float = 0.5) -> grow.Growth:
    return forest.forest_growth(kind, len(FEATURES), 2, positive, draws="md5", **CHECKED[kind])


def _paths(spark, models):
    """The nodes of members by their ways from the root."""
    parts = [m.to_paths(spark).select(F.lit(i).alias("member"), "*") for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts).withColumn("leaf", F.round("leaf", 6))


def _checked_forest(kind):
    @report
    def run(spark, sf_dir):
        data = binned_rows(_rows(spark, sf_dir), FEATURES, max_bins=BINS)
        try:
            fitted = forest.fit_forest(data, kind, 2, 2, draws="md5", **CHECKED[kind])
        finally:
            data.close()
        return _paths(spark, [fitted])

    return run


for _kind in CHECKED:
    query(f"forest_{_kind}_nodes", forest_sql(
        _checked_growth(_kind), {(0, t): s for t, s in forest.tree_seeds(2, 42).items()}, 2,
    ))(_checked_forest(_kind))


@query("forest_members_nodes", forest_sql(
    _checked_growth("subsample"),
    {(m, t): s for m in range(2) for t, s in forest.tree_seeds(2, 42 + m).items()}, 2))
@report
def q_forest_members_nodes(spark, sf_dir):
    """Sub-forests fitted side by side: five trees for two members, one is dropped."""
    data = binned_rows(_rows(spark, sf_dir), FEATURES, max_bins=BINS)
    try:
        members = forest.fit_members(data, "subsample", 5, 2, 2, draws="md5")
    finally:
        data.close()
    return _paths(spark, members)


@query("forest_model_parallel", forest_sql(
    _checked_growth("bootstrap"),
    {(m, t): s for m in range(4) for t, s in forest.tree_seeds(2, 42 + m).items()}, 2, _TRAIN,
    f"SELECT *, 8 AS total_trees FROM ({voted_quality_sql('voted', _TRAIN)})"))
@report
def q_forest_model_parallel(spark, sf_dir):
    """Sub-forests on the same rows, fitted side by side and averaged: nine trees for four
    members, one is dropped. Their quality on rows they have not seen."""
    train, test = _halves(spark, sf_dir)
    data = binned_rows(train, FEATURES, max_bins=BINS)
    try:
        members = forest.fit_members(data, "bootstrap", 9, 4, 2, draws="md5")
    finally:
        data.close()
    quality = metrics.evaluate(forest.score_members(test, members))
    total = sum(len(m.trees) for m in members)
    return _rounded(quality).withColumn("total_trees", F.lit(total))


@query("forest_members_mllib")
@report
def q_forest_members_mllib(spark, sf_dir):
    """MLlib sub-forests on the same rows, fitted side by side and averaged."""
    train, test = _halves(spark, sf_dir)
    ready = mllib.fit_ready(train, FEATURES, "row_id")
    try:
        members = mllib.fit_members(ready, n_trees=22, members=4, max_depth=5)
    finally:
        ready.unpersist()
    quality = metrics.evaluate(mllib.score_members(mllib.assembled(test, FEATURES), members))
    total = sum(m.getNumTrees for m in members)
    return quality.withColumn("total_trees", F.lit(total))


def _trial(spark, sf_dir, depth, **settings):
    train, test = _halves(spark, sf_dir)
    return sweep.Trial(train, test, FEATURES, depth=depth, learning_rate=ETA, **settings)


@query("forest_compare")
@report
def q_forest_compare(spark, sf_dir):
    """Three kinds of forest, as one fit and as sub-forests, with efficiency."""
    single, several = sweep.compare_forests(_trial(spark, sf_dir, 4), 8, 2, 4)
    compared = reports.single_vs_distributed(single, several, ["lib"])
    return reports.scaling_efficiency(compared, 2)


def _compared_sql(lib: str, kind: str, fit: str, seeds: dict) -> str:
    changes = sweep.compared_changes(lib, 2)
    growth = forest.forest_growth(kind, len(FEATURES), 2, 0.5, draws="md5", **changes)
    return "SELECT * FROM (" + forest_sql(growth, seeds, 2, _TRAIN, (
        f"SELECT '{lib}' AS lib, '{fit}' AS fit, accuracy, auc, {len(seeds)} AS trees "
        f"FROM ({voted_quality_sql('voted', _TRAIN)})")) + ")"


@query("forest_compare_quality", " UNION ALL ".join(
    _compared_sql(lib, kind, fit, seeds) for lib, (kind, _) in sweep.FORESTS.items()
    for fit, seeds in (
        ("single", {(0, t): s for t, s in forest.tree_seeds(4, 42).items()}),
        ("members", {(m, t): s for m in range(2)
                     for t, s in forest.tree_seeds(2, 42 + m).items()}))))
@report
def q_forest_compare_quality(spark, sf_dir):
    """What the comparison of one fit and of sub-forests says of their quality."""
    trial = _trial(spark, sf_dir, 2, max_bins=BINS)
    single, several = sweep.compare_forests(trial, 4, 2, 2, draws="md5")
    both = single.withColumn("fit", F.lit("single")).unionByName(
        several.withColumn("fit", F.lit("members")))
    return both.select("lib", "fit", F.round("accuracy", 9).alias("accuracy"),
                       F.round("auc", 9).alias("auc"), "trees")


@query("concurrent_fits", boost_sql(
    "SELECT fit::INT AS fit, 2 AS trees, round(sum(leaf), 6) AS leaf_sum "
    "FROM nodes, range(0, 4) t(fit) GROUP BY fit", rounds=2, depth=2))
@report
def q_concurrent_fits(spark, sf_dir):
    """Four equal fits at the same time on one set of blocks, which must agree."""
    data = binned_rows(_rows(spark, sf_dir), FEATURES, max_bins=BINS)
    try:
        fits = forest.side_by_side(
            spark, [lambda: boost_binned(data, _params(rounds=2, max_depth=2))] * 4
        )
    finally:
        data.close()
    rows = [(i, len(m.trees), round(sum(v for t in m.trees for v, f in zip(t.value, t.feature)
                                        if f < 0), 6)) for i, m in enumerate(fits)]
    return spark.createDataFrame(rows, "fit int, trees int, leaf_sum double")


_LOGIT = "(SELECT ln(avg(label) / (1 - avg(label))) FROM train)"


def _history_sql(name: str, **settings) -> str:
    rounds = " UNION ALL ".join(
        f"SELECT '{name}' AS name, {r} AS round, "
        f"round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS logloss "
        f"FROM (SELECT label, 1 / (1 + exp(-margin)) AS p FROM m{r})" for r in (1, 2))
    return f"SELECT * FROM ({boost_sql(rounds, rounds=2, depth=2, **settings)})"


@query("sweep_history", " UNION ALL ".join([
    _history_sql("xgboost_cpu", start=_LOGIT),
    _history_sql("catboost_cpu", policy="symmetric", l2=3.0),
    _history_sql("lightgbm_cpu", policy="leaf", num_leaves=4, l2=0.0, least="0.001",
                 min_rows=20, start=_LOGIT)]))
@report
def q_sweep_history(spark, sf_dir):
    """Log loss after every round for all three libraries, on rows binned once."""
    rows = _rows(spark, sf_dir)
    trial = sweep.Trial(rows, rows, FEATURES, depth=2, learning_rate=ETA, max_bins=BINS).prepared()
    try:
        parts = [sweep.round_history(trial, name, 2)
                 for name in ("xgboost_cpu", "catboost_cpu", "lightgbm_cpu")]
    finally:
        trial.close()
    return reduce(DataFrame.unionByName, parts).withColumn("logloss", F.round("logloss", 6))


_GRID = [(depth, eta) for depth in (1, 2) for eta in (0.1, 0.3)]


def _fold_sql(depth: int, eta: float, fold: int) -> str:
    used = f"row_id % 2 <> {fold}"
    return "(SELECT logloss FROM (" + boost_sql(
        quality_sql("m2", used, 12), rounds=2, depth=depth, eta=eta, used=used) + "))"


@query("boost_grid", f"""WITH losses AS (SELECT depth, eta, (one + other) / 2 AS loss FROM (
  {" UNION ALL ".join(
    f"SELECT {depth} AS depth, {eta}::DOUBLE AS eta, {_fold_sql(depth, eta, 0)} AS one, "
    f"{_fold_sql(depth, eta, 1)} AS other" for depth, eta in _GRID)}))
SELECT depth, eta, round(loss, 9) AS logloss, loss = (SELECT min(loss) FROM losses) AS best
FROM losses""")
@report
def q_boost_grid(spark, sf_dir):
    """A grid of settings over two folds, as Spark ML searches it, four fits at a time."""
    rows = _rows(spark, sf_dir).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    boost_ = estimator.TreeBoost(inputCols=FEATURES, maxIter=2, maxBins=BINS)
    grid = [{boost_.maxDepth: depth, boost_.stepSize: eta} for depth, eta in _GRID]
    search = CrossValidator(
        estimator=boost_, estimatorParamMaps=grid, evaluator=estimator.LogLossEvaluator(),
        numFolds=2, foldCol="fold", parallelism=4)
    found = search.fit(rows)
    best = (found.bestModel.getOrDefault("maxDepth"), found.bestModel.getOrDefault("stepSize"))
    made = [(*key, float(loss), key == best) for key, loss in zip(_GRID, found.avgMetrics)]
    return spark.createDataFrame(
        made, "depth int, eta double, logloss double, best boolean"
    ).withColumn("logloss", F.round("logloss", 9))


@query("sweep_small")
@report
def q_sweep_small(spark, sf_dir):
    """One round count over the CPU configurations, result rows with status."""
    chosen = sweep.Selection(skip_1gpu=True, skip_multi_gpu=True)
    return sweep.run_sweep(_trial(spark, sf_dir, 3), chosen, [2])


_SHARE = f"(SELECT ln(avg(label) / (1 - avg(label))) FROM train WHERE {_TRAIN})"


@query("single_run", boost_sql(
    f"SELECT round(accuracy, 4) AS accuracy, round(auc, 4) AS auc, 2 AS trees "
    f"FROM ({quality_sql('m2', _TRAIN)})",
    rounds=2, depth=2, policy="leaf", num_leaves=4, l2=0.0, least="0.001", min_rows=20,
    start=_SHARE, used=_TRAIN))
@report
def q_single_run(spark, sf_dir):
    """One configuration by its short name: its quality on rows it has not seen."""
    found = sweep.run_single(_trial(spark, sf_dir, 2, max_bins=BINS), "lgb-cpu", [2, 3])
    return spark.createDataFrame(
        [(found["accuracy"], found["auc"], found["trees"])],
        "accuracy double, auc double, trees int")


_LIBRARIES = {
    "xgboost": {"start": _SHARE},
    "catboost": {"policy": "symmetric", "l2": 3.0},
    "lightgbm": {"policy": "leaf", "num_leaves": 4, "l2": 0.0, "least": "0.001", "min_rows": 20,
                 "start": _SHARE},
}


@query("sweep_resumed", " UNION ALL ".join(
    "SELECT * FROM (" + boost_sql(
        f"SELECT 2 AS iterations, {pos} AS pos, '{lib}_cpu' AS name, 'ok' AS status, "
        f"round(accuracy, 4) AS accuracy, round(auc, 4) AS auc, 1::BIGINT AS times_run "
        f"FROM ({quality_sql('m2', _TRAIN)})", rounds=2, depth=2, used=_TRAIN, **settings) + ")"
    for pos, (lib, settings) in enumerate(_LIBRARIES.items())))
@report
def q_sweep_resumed(spark, sf_dir):
    """A sweep that is killed after its second run, and its second start, which runs what is
    left: the quality of every library, and how often it was fitted."""
    trial = _trial(spark, sf_dir, 2, max_bins=BINS)
    chosen = sweep.Selection(skip_1gpu=True, skip_multi_gpu=True, skip_rf=True)
    log, begun = run_dir(spark, "runs"), []

    def killed(trial, name, rounds):
        if len(begun) == 2:
            raise KeyboardInterrupt
        return counted(trial, name, rounds)

    def counted(trial, name, rounds):
        begun.append(name)
        return sweep.timed_run(trial, name, rounds)

    try:
        sweep.run_sweep(trial, chosen, [2], killed, log=log)
    except KeyboardInterrupt:
        pass
    rows = sweep.run_sweep(trial, chosen, [2], counted, log=log)
    times = spark.createDataFrame([(n,) for n in begun], "name string").groupBy("name").agg(
        F.count(F.lit(1)).alias("times_run"))
    return rows.join(times, "name").select(
        "iterations", "pos", "name", "status", "accuracy", "auc", "times_run")


@query("sweep_document", """SELECT iterations, name, (SELECT count(*) FROM orders) AS samples,
  4 AS features, 3 AS depth, 0.3::DOUBLE AS learning_rate, 8 AS lightgbm_num_leaves,
  true AS has_quality
FROM (VALUES (1), (2)) i(iterations),
     (VALUES ('xgboost_cpu'), ('catboost_cpu'), ('lightgbm_cpu')) c(name)""")
def q_sweep_document(spark, sf_dir):
    """A sweep's result document, written under its stamped name and read back."""
    chosen = sweep.Selection(skip_1gpu=True, skip_multi_gpu=True, skip_rf=True)
    path = sweep.sweep_document(
        _trial(spark, sf_dir, 3), chosen, [1, 2], run_dir(spark, "documents"))
    found = results.read_documents(spark, path)
    about = found.select("parameters.*", F.explode("benchmarks").alias("b"))
    return about.select(
        "b.iterations", F.explode("b.results").alias("name", "r"), "samples", "features",
        "depth", "learning_rate", "lightgbm_num_leaves",
    ).withColumn("has_quality", F.col("r.accuracy").between(0, 1) & F.col("r.auc").between(0, 1)
                 & (F.col("r.time_seconds") >= 0)).drop("r")
