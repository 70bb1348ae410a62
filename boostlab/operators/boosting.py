"""Second-order gradient boosting: level-wise, symmetric and leaf-wise trees."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.operators.binning import Edges, exact_edges
from boostlab.operators.grow import (
    BLOCK, Growth, add_margin, cached, grow_trees, make_blocks,
)
from boostlab.operators.model import Tree, TreeModel
from boostlab.session import drop_dir, run_dir, steady_session

# Rounds between two written copies of the margins: bounds the lineage a lost
# executor costs, and the size of the query plan.
WRITE_EVERY = 10


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 100
    growth: str = "level"
    max_depth: int = 6
    learning_rate: float = 0.1
    num_leaves: int | None = None
    max_bins: int = 256
    l2: float = 1.0
    min_child: float = 1.0
    min_rows: int = 0  # least rows per leaf, for level-wise and leaf-wise trees
    from_share: bool = False  # start at the share of class 1, not at one half
    seed: int = 42


def stored_blocks(df: DataFrame, row_id: str, label: str, edges: Edges, path: str) -> DataFrame:
    """Blocks of the training rows, read from their copy in the shared folder.

    Passes over the blocks, and the work of a lost executor, start from that copy
    and never from the source.
    """
    make_blocks(df, row_id, label, edges).write.parquet(path)
    return steady_session(df.sparkSession).read.schema(BLOCK).parquet(path)


@dataclass
class Binned:
    """Binned training rows, ready for any number of fits."""

    blocks: DataFrame
    edges: Edges
    positive: float
    n_rows: int
    home: str

    def close(self) -> None:
        self.blocks.unpersist()
        drop_dir(self.blocks.sparkSession, self.home)

    def logit(self) -> float:
        """The margin of the share of class 1, 0 where there is one class alone."""
        share = self.positive or 0.0
        return math.log(share / (1.0 - share)) if 0.0 < share < 1.0 else 0.0


def binned_rows(
    df: DataFrame, features: Sequence[str], label: str = "label", row_id: str = "row_id",
    max_bins: int = 256, edges: Edges | None = None,
) -> Binned:
    """Find edges, bin the rows and keep them in the shared folder until closed."""
    home = run_dir(df.sparkSession, "binned")
    edges = edges or exact_edges(df, list(features), max_bins)
    blocks = cached(stored_blocks(df, row_id, label, edges, f"{home}/0"))
    positive, n_rows = blocks.agg(F.sum("n_pos") / F.sum("n"), F.sum("n")).first()
    return Binned(blocks, edges, positive, n_rows or 0, home)


def boost(
    df: DataFrame, features: Sequence[str], params: BoostParams, label: str = "label",
    row_id: str = "row_id", edges: Edges | None = None,
) -> TreeModel:
    """Fit a boosted model of binary labels. Rows stay distributed; trees reach the driver."""
    data = binned_rows(df, features, label, row_id, params.max_bins, edges)
    try:
        return boost_binned(data, params)
    finally:
        data.close()


def _growth(data: Binned, params: BoostParams) -> Growth:
    return Growth(
        policy=params.growth, max_depth=params.max_depth, num_leaves=params.num_leaves,
        l2=params.l2, min_child=params.min_child, min_rows=params.min_rows,
        shrink=params.learning_rate, base=data.logit() if params.from_share else 0.0,
    )


class _Margins:
    """Blocks whose margins follow the trees of a fit, one cached copy per round.

    Every ``WRITE_EVERY`` rounds they are written to the shared folder, which bounds both
    what a lost executor costs and the size of the query plan.
    """

    def __init__(self, blocks: DataFrame, edges: Edges, home: str) -> None:
        self.blocks, self.edges, self.home = blocks, edges, home
        self.rounds = 0
        self.stale: list[DataFrame] = []

    def advance(self, tree: Tree, base: float | None = None) -> None:
        """Add a tree's values; the old copy is dropped by :meth:`settle`, when the new one
        has been read. With a ``base``, blocks carry their summed log loss too."""
        spark = self.blocks.sparkSession
        if self.rounds:  # the first blocks belong to the caller
            self.stale.append(self.blocks)
        self.rounds += 1
        blocks = add_margin(self.blocks, tree, self.edges, base)
        if self.rounds % WRITE_EVERY == 0:
            copy = f"{self.home}/{self.rounds}"
            blocks.write.parquet(copy)
            blocks = spark.read.parquet(copy)
            drop_dir(spark, f"{self.home}/{self.rounds - WRITE_EVERY}")
        self.blocks = cached(blocks)

    def settle(self) -> None:
        while self.stale:
            self.stale.pop().unpersist()

    def close(self) -> None:
        self.settle()
        if self.rounds:
            self.blocks.unpersist()
        drop_dir(self.blocks.sparkSession, self.home)


def _grown(data: Binned, params: BoostParams) -> Iterator[Tree]:
    """The trees of a fit, one after the other, for as long as they are asked for."""
    growth = _growth(data, params)
    # Boosting uses every row every round, so row ids are not carried along.
    margins = _Margins(data.blocks.drop("ids"), data.edges,
                       run_dir(data.blocks.sparkSession, "boost"))
    try:
        for round_ in range(params.rounds):
            tree = grow_trees(
                margins.blocks, data.edges, growth, {0: params.seed + round_}, data.n_rows)[0]
            margins.settle()  # the first level of this round has filled the new cache
            yield tree
            if round_ + 1 < params.rounds:
                margins.advance(tree)
    finally:
        margins.close()


def boost_binned(data: Binned, params: BoostParams) -> TreeModel:
    """Fit on rows binned before; their bins rule, not those of ``params``."""
    trees = list(_grown(data, params))
    return TreeModel(list(data.edges), data.edges, trees, base=_growth(data, params).base)


@dataclass
class Watched:
    """A fit watched on evaluation rows: the model of its best round, the trees of all rounds
    that were run, and the rows' mean log loss after each."""

    model: TreeModel
    trees: list[Tree]
    losses: list[float]


def boost_watched(
    data: Binned, watch: Binned, params: BoostParams, patience: int | None = None
) -> Watched:
    """Fit while watching evaluation rows, and keep the earliest round of least loss.

    The evaluation rows, binned with the edges of the training rows, keep margins of their
    own, so a round's loss costs one tree. The fit ends after ``patience`` rounds without a
    lower loss; without a patience, or without evaluation rows, all rounds are run.
    """
    if watch.edges != data.edges:
        raise ValueError("evaluation rows binned with other edges than the training rows")
    base = _growth(data, params).base
    spark = data.blocks.sparkSession
    margins = _Margins(watch.blocks.drop("ids"), watch.edges, run_dir(spark, "watched"))
    trees: list[Tree] = []
    losses: list[float] = []
    best = 0
    growing = _grown(data, params)
    try:
        for tree in growing:
            trees.append(tree)
            margins.advance(tree, base)
            loss, rows = margins.blocks.agg(F.sum("loss"), F.sum("n")).first()
            margins.settle()
            losses.append(loss / rows if rows else math.nan)
            if not rows or losses[-1] < losses[best]:
                best = len(losses) - 1
            if patience is not None and len(losses) - 1 - best >= patience:
                break
    finally:
        growing.close()
        margins.close()
    model = TreeModel(list(data.edges), data.edges, trees[:best + 1], base=base)
    return Watched(model, trees, losses)
