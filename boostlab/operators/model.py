"""Tree models: a small table of nodes, and scoring DataFrames with it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.functions.scalars import decide, logistic
from boostlab.operators.binning import Edges
from boostlab.operators.metrics import CLIP

TABLE = "tree int, node int, feature string, threshold double, left int, right int, leaf double"


@dataclass
class Tree:
    """Nodes by number, root first. A leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def add(self) -> int:
        for column, default in ((self.feature, -1), (self.cut, 0), (self.left, -1),
                                (self.right, -1), (self.value, 0.0)):
            column.append(default)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        self.left[node], self.right[node] = self.add(), self.add()
        return self.left[node], self.right[node]

    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


def route(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf every row of ``bins[feature, row]`` ends in."""
    own = np.arange(len(tree.feature), dtype=np.int32)
    feature = np.asarray(tree.feature, dtype=np.int64)
    inner = feature >= 0
    # A leaf leads to itself, whatever it is asked.
    left, right = (np.where(inner, side, own).astype(np.int32) for side in (tree.left, tree.right))
    cut = np.asarray(tree.cut, dtype=np.int32)
    n = bins.shape[1]
    first = np.maximum(feature, 0) * n
    cells, rows = bins.ravel(), np.arange(n)
    node = np.zeros(n, dtype=np.int32)
    for _ in range(tree.depth):
        above = cells.take(first.take(node) + rows) > cut.take(node)
        node = np.where(above, right.take(node), left.take(node))
    return node


def to_bins(values: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Bin matrix ``[feature, row]``: the number of edges below each value."""
    small = max((len(e) for e in edges), default=0) < 256
    bins = np.empty((len(edges), len(values[0])), dtype=np.uint8 if small else np.uint16)
    for f, (column, cuts) in enumerate(zip(values, edges)):
        bins[f] = np.searchsorted(cuts, column, side="left")
    return bins


@dataclass
class TreeModel:
    """Trees over named features, summed or averaged, with a link to probability."""

    features: list[str]
    edges: Edges
    trees: list[Tree]
    base: float = 0.0
    mean: bool = False
    link: str = "logistic"

    def threshold(self, feature: int, cut: int) -> float:
        return self.edges[self.features[feature]][cut]

    def first(self, rounds: int) -> TreeModel:
        """The model as it was after some rounds."""
        return replace(self, trees=self.trees[:rounds])

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row per node: ``tree, node, feature, threshold, left, right, leaf``."""
        rows = [
            (t, n, None, None, None, None, float(tree.value[n])) if f < 0 else
            (t, n, self.features[f], self.threshold(f, tree.cut[n]), tree.left[n],
             tree.right[n], None)
            for t, tree in enumerate(self.trees) for n, f in enumerate(tree.feature)
        ]
        return spark.createDataFrame(rows, TABLE)

    def to_paths(self, spark: SparkSession) -> DataFrame:
        """One row per node by its way from the root, such as ``LR``."""
        rows = []
        for t, tree in enumerate(self.trees):
            ways = {0: ""}
            for n, f in enumerate(tree.feature):
                if f < 0:
                    rows.append((t, ways[n], None, None, float(tree.value[n])))
                    continue
                ways[tree.left[n]], ways[tree.right[n]] = ways[n] + "L", ways[n] + "R"
                rows.append((t, ways[n], self.features[f], self.threshold(f, tree.cut[n]), None))
        return spark.createDataFrame(
            rows, "tree int, path string, feature string, threshold double, leaf double"
        )

    def edge_table(self, spark: SparkSession) -> DataFrame:
        """One row per edge: ``feature, position, edge``."""
        rows = [(f, i, float(e)) for f in self.features for i, e in enumerate(self.edges[f])]
        return spark.createDataFrame(rows, "feature string, position int, edge double")

    @classmethod
    def from_table(cls, table: DataFrame, features: list[str], edges: DataFrame | None = None,
                   **settings) -> TreeModel:
        """The model of a node table, and of its edge table; without one, the thresholds
        become the edges."""
        rows = table.orderBy("tree", "node").collect()
        if edges is None:
            edges: Edges = {f: sorted({r["threshold"] for r in rows if r["feature"] == f})
                            for f in features}
        else:
            held = edges.orderBy("feature", "position").collect()
            edges = {f: [r["edge"] for r in held if r["feature"] == f] for f in features}
        trees: dict[int, Tree] = {}
        for r in rows:
            tree = trees.setdefault(r["tree"], Tree([], [], [], [], []))
            inner = r["feature"] is not None
            tree.feature.append(features.index(r["feature"]) if inner else -1)
            tree.cut.append(edges[r["feature"]].index(r["threshold"]) if inner else 0)
            tree.left.append(r["left"] if inner else -1)
            tree.right.append(r["right"] if inner else -1)
            tree.value.append(0.0 if inner else r["leaf"])
        for tree in trees.values():
            tree.depth = _depth(tree, 0)
        return cls(features, edges, [trees[t] for t in sorted(trees)], **settings)

    def _proba(self, margin):
        return 1.0 / (1.0 + np.exp(-margin)) if self.link == "logistic" else margin

    def _matrix(self, columns: list[pd.Series]) -> np.ndarray:
        cuts = [np.asarray(self.edges[f], dtype=float) for f in self.features]
        return to_bins([c.to_numpy(dtype=float) for c in columns], cuts)

    def _nodes(self) -> int:
        return sum(len(t.feature) for t in self.trees)


def _depth(tree: Tree, node: int) -> int:
    if tree.feature[node] < 0:
        return 0
    return 1 + max(_depth(tree, tree.left[node]), _depth(tree, tree.right[node]))


def _tree_expression(model: TreeModel, tree: Tree, node: int = 0) -> Column:
    f = tree.feature[node]
    if f < 0:
        return F.lit(float(tree.value[node]))
    below = F.col(model.features[f]) <= F.lit(model.threshold(f, tree.cut[node]))
    return F.when(below, _tree_expression(model, tree, tree.left[node])).otherwise(
        _tree_expression(model, tree, tree.right[node])  # NULL and NaN too
    )


# A model of up to so many nodes becomes one SQL expression; the JVM compiles that
# well, while larger ones outgrow its method size and go to vectorised batches. Both
# add the trees in the same order and send missing values (NULL, NaN) to the right.
EXPRESSION_NODES = 255
# Rows of a task that are worth preparing a larger model's bit masks.
BIT_ROWS = 16_384


def margin_column(model: TreeModel) -> Column:
    """Sum or mean of tree values plus the base, as a column over the feature columns."""
    weight = 1.0 / len(model.trees) if model.mean and model.trees else 1.0
    if model._nodes() <= EXPRESSION_NODES:
        total = F.lit(0.0)
        for tree in model.trees:
            total = total + _tree_expression(model, tree)
        return total * F.lit(weight) + F.lit(model.base)

    after = BIT_ROWS

    @F.pandas_udf("double")
    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        from boostlab.operators.bitscore import BitTrees

        masks, seen = None, 0
        for batch in batches:
            bins = model._matrix([batch[f] for f in model.features])
            seen += bins.shape[1]
            if masks is None and seen > after:
                masks = BitTrees(model.trees, 1 + max(len(e) for e in model.edges.values()))
            if masks:
                total = masks.totals(bins)
            else:
                total = np.zeros(bins.shape[1])
                for tree in model.trees:
                    total += np.asarray(tree.value)[route(tree, bins)]
            yield pd.Series(total * weight + model.base)

    return margins(F.struct(*[F.col(f).cast("double").alias(f) for f in model.features]))


def score(df: DataFrame, model: TreeModel, proba: str = "proba",
          prediction: str = "prediction") -> DataFrame:
    """Add the probability of class 1 and the decision; rows stay where they are."""
    margin = margin_column(model)
    value = logistic(margin) if model.link == "logistic" else margin
    return df.withColumn(proba, value).withColumn(prediction, decide(F.col(proba)))


def eval_history(df: DataFrame, model: TreeModel, label: str = "label") -> DataFrame:
    """Mean log loss after every round, from one pass: ``round, logloss``.

    A model that averages its trees averages those so far. Each task sends one partial sum per round, whatever its rows.
    """
    rounds = len(model.trees)

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(rounds), 0
        for batch in batches:
            bins = model._matrix([batch[f] for f in model.features])
            y = batch["_label"].to_numpy(dtype=float)
            summed = np.zeros(len(y))
            for t, tree in enumerate(model.trees):
                summed += np.asarray(tree.value)[route(tree, bins)]
                margin = model.base + (summed / (t + 1) if model.mean else summed)
                p = np.clip(model._proba(margin), CLIP, 1.0 - CLIP)
                total[t] -= np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))
            seen += len(y)
        yield pd.DataFrame({"round": np.arange(1, rounds + 1), "loss": total, "n": seen})

    needed = df.select(
        *[F.col(f).cast("double").alias(f) for f in model.features], F.col(label).alias("_label")
    )
    parts = needed.mapInPandas(losses, "round int, loss double, n long")
    return parts.groupBy("round").agg((F.sum("loss") / F.sum("n")).alias("logloss"))


def best_round(history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The round of least loss, the earliest of equals."""
    return history.groupBy(*by).agg(F.min(F.struct("logloss", "round")).alias("best")).select(
        *by, F.col("best.round").alias("round"), F.col("best.logloss").alias("logloss")
    )
