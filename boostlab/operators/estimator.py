"""The boosted learners as Spark ML stages: parameters, pipelines, grids, persistence."""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasInputCols, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed,
    HasStepSize,
)
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.operators.boosting import Binned, BoostParams, binned_rows, boost_binned
from boostlab.operators.metrics import logloss
from boostlab.operators.model import TreeModel, score


class _BoostParams(HasInputCols, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol,
                   HasSeed, HasStepSize):
    growth = Param(Params._dummy(), "growth", "level, symmetric or leaf", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "most leaves of a leaf-wise tree, 0 for a "
                      "full one", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "penalty on leaf values", TypeConverters.toFloat)
    minChild = Param(Params._dummy(), "minChild", "least weight of a leaf", TypeConverters.toFloat)
    minRows = Param(Params._dummy(), "minRows", "least rows of a leaf", TypeConverters.toInt)
    fromShare = Param(Params._dummy(), "fromShare", "start at the share of class 1",
                      TypeConverters.toBoolean)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(
            growth="level", maxDepth=6, numLeaves=0, maxBins=256, l2=1.0, minChild=1.0, minRows=0,
            fromShare=False, maxIter=100, stepSize=0.1, seed=42, labelCol="label",
            predictionCol="prediction", probabilityCol="proba")

    def _settings(self) -> BoostParams:
        get = self.getOrDefault
        return BoostParams(
            rounds=get("maxIter"), growth=get("growth"), max_depth=get("maxDepth"),
            learning_rate=get("stepSize"), num_leaves=get("numLeaves") or None,
            max_bins=get("maxBins"), l2=get("l2"), min_child=get("minChild"),
            min_rows=get("minRows"), from_share=get("fromShare"), seed=get("seed"))


class _SharedBins:
    """Rows binned once for all fits of a grid that agree on them; the last fit drops them."""

    def __init__(self, dataset: DataFrame, wanted: list[tuple]) -> None:
        self.dataset, self.left = dataset, {key: wanted.count(key) for key in wanted}
        self.held: dict[tuple, Binned] = {}
        self.lock = threading.Lock()

    def take(self, key: tuple) -> Binned:
        features, label, bins = key
        with self.lock:
            if key not in self.held:
                rows = self.dataset.select(*features, label).withColumn(
                    "_row", F.monotonically_increasing_id())
                self.held[key] = binned_rows(rows, list(features), label, "_row", bins)
            return self.held[key]

    def give_back(self, key: tuple) -> None:
        with self.lock:
            self.left[key] -= 1
            if not self.left[key] and key in self.held:
                self.held.pop(key).close()


class TreeBoost(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Second-order boosting of binary labels over plain feature columns (``inputCols``)."""

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", growth="level", maxIter=100,
                 maxDepth=6, stepSize=0.1, numLeaves=0, maxBins=256, l2=1.0, minChild=1.0,
                 minRows=0, fromShare=False, seed=42, predictionCol="prediction",
                 probabilityCol="proba"):
        super().__init__()
        given = self._input_kwargs
        self._set(**{k: v for k, v in given.items() if v is not None})

    def _key(self) -> tuple:
        return tuple(self.getInputCols()), self.getLabelCol(), self.getOrDefault("maxBins")

    def _fit(self, dataset: DataFrame) -> TreeBoostModel:
        return self._fit_shared(_SharedBins(dataset, [self._key()]))

    def _fit_shared(self, bins: _SharedBins) -> TreeBoostModel:
        key = self._key()
        try:
            fitted = boost_binned(bins.take(key), self._settings())
        finally:
            bins.give_back(key)
        return self._copyValues(TreeBoostModel(fitted))

    def fitMultiple(self, dataset: DataFrame, paramMaps) -> Iterator:
        """Fits of a grid, which may be asked for by several threads; equal bins are made
        once."""
        copies = [self.copy(extra) for extra in paramMaps]
        bins = _SharedBins(dataset, [one._key() for one in copies])
        todo, lock = iter(enumerate(copies)), threading.Lock()

        class Fits:
            def __iter__(self):
                return self

            def __next__(self):
                with lock:
                    i, one = next(todo)
                return i, one._fit_shared(bins)

        return Fits()


class TreeBoostModel(Model, _BoostParams, MLWritable, MLReadable):
    """Fitted trees; adds the probability of class 1 and the decision."""

    def __init__(self, trees: TreeModel | None = None) -> None:
        super().__init__()
        self.trees = trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        proba, decision = self.getProbabilityCol(), self.getPredictionCol()
        scored = score(dataset, self.trees, proba, decision)
        return scored.withColumn(decision, F.col(decision).cast("double"))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    """Parameters as metadata; nodes and edges as tables."""

    def __init__(self, instance: TreeBoostModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model, spark = self.instance.trees, self.sparkSession
        about = {"features": model.features, "base": model.base, "mean": model.mean,
                 "link": model.link}
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, {"trees": about})
        model.to_table(spark).write.parquet(f"{path}/nodes")
        model.edge_table(spark).write.parquet(f"{path}/edges")


class _ModelReader(MLReader):
    def load(self, path: str) -> TreeBoostModel:
        spark = self.sparkSession
        name = f"{TreeBoostModel.__module__}.{TreeBoostModel.__name__}"
        metadata = DefaultParamsReader.loadMetadata(path, spark, name)
        about = metadata["trees"]
        features = about.pop("features")
        trees = TreeModel.from_table(
            spark.read.parquet(f"{path}/nodes"), features, spark.read.parquet(f"{path}/edges"),
            **about)
        loaded = TreeBoostModel(trees)
        DefaultParamsReader.getAndSetParams(loaded, metadata)
        loaded._resetUid(metadata["uid"])
        return loaded


class LogLossEvaluator(Evaluator, HasLabelCol, HasProbabilityCol, DefaultParamsReadable,
                       DefaultParamsWritable):
    """Mean log loss of a probability column; less is better."""

    @keyword_only
    def __init__(self, *, labelCol="label", probabilityCol="proba"):
        super().__init__()
        self._setDefault(labelCol="label", probabilityCol="proba")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        return dataset.agg(logloss(F.col(self.getLabelCol()), F.col(self.getProbabilityCol()))
                           ).first()[0]

    def isLargerBetter(self) -> bool:
        return False
