import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import functions as F

from boostlab.operators import boosting, estimator, model
from boostlab.operators.estimator import LogLossEvaluator, TreeBoost, TreeBoostModel
from boostlab.sources import generators

FEATURES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def rows(spark):
    made = generators.gen_classification(generators.row_ids(spark, 600, 3), 4, 3, 1, mode="fast")
    return made.withColumn("extra", F.lit("x")).persist()


def _scores(df):
    return [(r["row_id"], r["proba"], r["prediction"]) for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("growth", ["level", "symmetric", "leaf"])
def test_a_fit_is_that_of_the_function(rows, growth):
    settings = dict(growth=growth, max_depth=3, learning_rate=0.3, max_bins=32, num_leaves=5)
    want = model.score(rows, boosting.boost(
        rows, FEATURES, boosting.BoostParams(rounds=3, **settings)))
    got = TreeBoost(inputCols=FEATURES, maxIter=3, growth=growth, maxDepth=3, stepSize=0.3,
                    maxBins=32, numLeaves=5).fit(rows).transform(rows)
    for (i, p, decided), (j, q, other) in zip(_scores(got), _scores(want), strict=True):
        assert i == j and p == pytest.approx(q, abs=1e-12) and decided == other
    assert got.columns == want.columns
    assert "extra" in got.columns


def test_a_saved_model_scores_alike(rows, tmp_path):
    fitted = TreeBoost(inputCols=FEATURES, maxIter=4, maxDepth=4, maxBins=32, fromShare=True,
                       probabilityCol="p1").fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = TreeBoostModel.load(str(tmp_path / "model"))
    assert loaded.uid == fitted.uid and loaded.getProbabilityCol() == "p1"
    assert loaded.trees == fitted.trees
    one, other = (m.transform(rows).select("row_id", "p1").collect() for m in (fitted, loaded))
    assert sorted(one) == sorted(other)


def test_in_a_saved_pipeline(rows, tmp_path):
    doubled = SQLTransformer(statement="SELECT *, f0 * 2 AS g0 FROM __THIS__")
    boost = TreeBoost(inputCols=["g0", "f1"], maxIter=2, maxDepth=2)
    pipeline = Pipeline(stages=[doubled, boost])
    pipeline.save(str(tmp_path / "pipeline"))
    fitted = Pipeline.load(str(tmp_path / "pipeline")).fit(rows)
    fitted.save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert _scores(loaded.transform(rows)) == _scores(fitted.transform(rows))
    assert [t.cut for t in loaded.stages[1].trees.trees] == [
        t.cut for t in pipeline.fit(rows).stages[1].trees.trees]


def test_a_grid_side_by_side_bins_once(rows, monkeypatch):
    made = []
    real = boosting.make_blocks
    monkeypatch.setattr(boosting, "make_blocks", lambda *a: made.append(1) or real(*a))
    boost = TreeBoost(inputCols=FEATURES, maxIter=2, maxBins=32)
    grid = [{boost.maxDepth: d} for d in (1, 2, 3)]
    found = TrainValidationSplit(
        estimator=boost, estimatorParamMaps=grid, evaluator=LogLossEvaluator(), parallelism=3,
        seed=7).fit(rows)
    assert len(made) == 2  # the grid, and the best one on all rows
    assert min(found.validationMetrics) == found.validationMetrics[
        found.bestModel.getOrDefault("maxDepth") - 1]


def test_bins_are_dropped_after_a_failing_fit(rows, monkeypatch):
    closed = []
    monkeypatch.setattr(boosting.Binned, "close", lambda self: closed.append(1))
    monkeypatch.setattr(estimator, "boost_binned", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        TreeBoost(inputCols=FEATURES).fit(rows)
    assert closed == [1]
