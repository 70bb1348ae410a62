"""Forests: one fit over partitioned data, or sub-forests fitted side by side.

Trees of a forest do not depend on each other, so a fit grows all of them level
by level in the same jobs. Which rows and features a tree sees depends on seed
and ids alone: a forest is the same on any number of partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.functions.scalars import decide
from boostlab.operators.boosting import Binned
from boostlab.operators.boosting import binned_rows as forest_data
from boostlab.operators.ensemble import soft_vote
from boostlab.operators.grow import Growth, grow_trees
from boostlab.operators.model import TreeModel, score


def forest_growth(kind: str, n_features: int, max_depth: int, positive: float,
                  **changes) -> Growth:
    """Settings of a kind of forest.

    ``bootstrap``: rows drawn with replacement, a square root of the features per
    node, leaves hold the share of class 1. ``subsample``: 0.8 of the rows and of
    the features per node, second-order trees. ``bagged``: 0.632 of the rows,
    best-first trees of limited leaves.
    """
    logit = math.log(positive / (1.0 - positive)) if 0.0 < positive < 1.0 else 0.0
    weight = positive * (1.0 - positive)
    # Shares, leaf limits and least leaf sizes of the kinds.
    kinds = {
        "bootstrap": Growth(
            objective="mean", base=positive, bootstrap=True, l2=0.0, min_child=1.0,
            node_features=math.sqrt(n_features) / n_features,
        ),
        "subsample": Growth(base=logit, row_share=0.8, node_features=0.8, l2=1.0, min_child=1.0),
        "bagged": Growth(base=logit, policy="leaf", num_leaves=300, row_share=0.632, l2=0.0,
                         min_child=20.0 * weight),
    }
    return replace(kinds[kind], max_depth=max_depth, shrink=1.0, **changes)


def tree_seeds(n_trees: int, seed: int) -> dict[int, int]:
    """The seed of every tree of a fit."""
    return {t: seed * 1_000_003 + t for t in range(n_trees)}


def fit_forest(data: Binned, kind: str, n_trees: int, max_depth: int, seed: int = 42,
               **changes) -> TreeModel:
    """Fit ``n_trees`` trees; their mean, behind the link, is the probability."""
    growth = forest_growth(kind, len(data.edges), max_depth, data.positive, **changes)
    seeds = tree_seeds(n_trees, seed)
    trees = grow_trees(data.blocks, data.edges, growth, seeds, data.n_rows)
    link = "identity" if growth.objective == "mean" else "logistic"
    return TreeModel(list(data.edges), data.edges, [trees[t] for t in seeds],
                     base=growth.base, mean=True, link=link)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], pool: str = "members") -> list:
    """Run driver-side fits at the same time; Spark shares its cores among their jobs."""
    def start(job: Callable, lane: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{pool}-{lane}")
        return job()

    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as threads:
        running = [
            threads.submit(inheritable_thread_target(spark)(start), job, lane)
            for lane, job in enumerate(jobs)
        ]
        return [r.result() for r in running]


def fit_members(data: Binned, kind: str, n_trees: int, members: int, max_depth: int,
                seed: int = 42, **changes) -> list[TreeModel]:
    """``members`` independent sub-forests of ``n_trees // members`` trees on all rows.

    Every member reads the same distributed blocks; nothing is copied per member.
    The remainder of the division is dropped.
    """
    each = n_trees // members
    jobs = [
        lambda i=i: fit_forest(data, kind, each, max_depth, seed + i, **changes)
        for i in range(members)
    ]
    return side_by_side(data.blocks.sparkSession, jobs)


def score_members(df: DataFrame, models: Sequence[TreeModel]) -> DataFrame:
    """Member probabilities ``p0..``, their mean ``proba`` and the decision."""
    names = [f"p{i}" for i in range(len(models))]
    for name, model in zip(names, models):
        df = score(df, model, name).drop("prediction")
    voted = df.withColumn("proba", soft_vote([F.col(n) for n in names]))
    return voted.withColumn("prediction", decide(F.col("proba")))
