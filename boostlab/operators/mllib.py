"""Boosting and forests with Spark's own MLlib learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.functions.scalars import decide
from boostlab.operators.ensemble import soft_vote
from boostlab.operators.forest import side_by_side
from boostlab.operators.shaping import lay_out
from boostlab.session import drop_dir, run_dir

VECTOR = "features"
# Bytes of the numbers in a partition. Kept rows and MLlib's own copies of them take some
# times that, and a task of a fit reads them all.
PARTITION_BYTES = 32 << 20


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature columns as one vector column, beside the others."""
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(df)


def fit_ready(df: DataFrame, features: Sequence[str], row_id: str,
              partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Assembled rows in a fixed layout, cached: MLlib samples by partition and order.

    The partitions follow the size of the vectors, so the layout is the same on any cluster.
    """
    partitions = max(1, -(-df.count() * 8 * (len(features) + 2) // partition_bytes))
    return assembled(lay_out(df, row_id, partitions), features).persist()


def gbt(max_iter: int, max_depth: int, step: float, seed: int = 42, bins: int = 32) -> GBTClassifier:
    return GBTClassifier(
        featuresCol=VECTOR, labelCol="label", maxIter=max_iter, maxDepth=max_depth,
        stepSize=step, maxBins=bins, seed=seed,
    )


def forest(n_trees: int, max_depth: int, seed: int = 42, bootstrap: bool = True,
           row_share: float = 1.0, feature_share: str = "sqrt") -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=VECTOR, labelCol="label", numTrees=n_trees, maxDepth=max_depth, seed=seed,
        bootstrap=bootstrap, subsamplingRate=row_share, featureSubsetStrategy=feature_share,
    )


def detached(model):
    """A fitted model as its saved copy. A forest's training summary holds the session and
    all that hangs on it, which a task cannot take along; the copy has no summary."""
    path = run_dir(SparkSession.active(), "model")
    model.write().save(path)
    try:
        return type(model).load(path)
    finally:
        drop_dir(SparkSession.active(), path)


def scored(df: DataFrame, model, proba: str = "proba") -> DataFrame:
    """Add the probability of class 1; the model's other columns are dropped."""
    out = model.transform(df).withColumn(proba, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def fit_members(ready: DataFrame, n_trees: int, members: int, max_depth: int, seed: int = 42):
    """Independent sub-forests of ``n_trees // members`` trees, fitted at the same time."""
    each = n_trees // members
    jobs = [lambda i=i: detached(forest(each, max_depth, seed + i).fit(ready))
            for i in range(members)]
    return side_by_side(ready.sparkSession, jobs)


def score_members(df: DataFrame, models: Sequence) -> DataFrame:
    """Mean of the member probabilities and the decision."""
    names = [f"p{i}" for i in range(len(models))]
    for name, model in zip(names, models):
        df = scored(df, model, name)
    voted = df.withColumn("proba", soft_vote([F.col(n) for n in names]))
    return voted.withColumn("prediction", decide(F.col("proba")))


def round_losses(model: GBTClassificationModel, df: DataFrame) -> list[float]:
    """Mean log loss after every round. MLlib reports twice the log loss."""
    return [loss / 2.0 for loss in model.evaluateEachIteration(df)]
