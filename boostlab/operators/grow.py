"""Growing trees level by level over a table of binned row blocks.

Training rows are binned once and stored as blocks: one DataFrame row holds some
thousand training rows as byte arrays. A level costs one Spark job: every task
adds its blocks into one histogram (numpy inside ``mapInArrow``), Spark shuffles
and sums the histograms and picks the best splits, and only those reach the
driver. Trees grown together share the job.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boostlab.functions.rand import literal_uniforms
from boostlab.operators.binning import Edges
from boostlab.operators.metrics import CLIP
from boostlab.operators.model import Tree, route, to_bins

BLOCK = "n int, n_pos int, ids binary, label binary, bins binary, margin binary"
SUMS = "tree int, node int, feature int, g binary, h binary"
CUTS = (
    "tree int, node int, feature int, bin int, gain double, gl double, hl double, "
    "gt double, ht double"
)
# Histogram cells a task may hold at once; more open nodes, or more features, take several
# tasks of the job.
MAX_CELLS = 4_000_000
# Cells of a level that come to the driver, 16 to 24 bytes each, and cells of all its map
# tasks up to which they come as they are, without a shuffle that sums them first.
POOL_CELLS, DIRECT_CELLS = 1_000_000, 4_000_000
SUM_TASK_BYTES = 8 << 20
# Row-feature pairs that a task adds up, about a second's work. The data set the number of
# tasks beyond a few per core, so none grows with the table.
TASK_PAIRS = 256_000_000
# Histograms of more tasks than these are summed in two steps, first in lanes.
ONE_STEP = 128
# Rows of a block, fewer for wide tables: numpy calls cost the same for any block.
BLOCK_ROWS = 65_536
BLOCK_CELLS = 16_000_000


@dataclass(frozen=True)
class Growth:
    """How trees grow."""

    policy: str = "level"  # level, symmetric or leaf
    max_depth: int = 6
    num_leaves: int | None = None  # for the leaf policy
    l2: float = 1.0
    min_child: float = 1.0
    min_rows: int = 0  # least rows on either side of a cut; 0 keeps no counts
    shrink: float = 0.1
    objective: str = "logistic"  # or mean: leaves hold label means
    base: float = 0.0
    row_share: float = 1.0  # of rows per tree, drawn without replacement
    bootstrap: bool = False  # rows per tree drawn with replacement
    node_features: float = 1.0  # share of features offered to a node
    tree_features: float = 1.0  # share of features offered to a tree
    draws: str = "fast"  # of rows; md5 ones can be drawn again by any SQL engine


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    gl: float
    hl: float
    gt: float
    ht: float


def make_blocks(df: DataFrame, row_id: str, label: str, edges: Edges) -> DataFrame:
    """Bin training rows into blocks, each of some Arrow batches of rows."""
    cuts = [np.asarray(c, dtype=float) for c in edges.values()]
    room = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, len(cuts))))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, label, *values = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        bins = to_bins(values, cuts)
        return pa.RecordBatch.from_pydict({
            "n": pa.array([len(ids)], pa.int32()),
            "n_pos": pa.array([int(label.sum())], pa.int32()),
            "ids": [ids.astype(np.int64).tobytes()],
            "label": [label.astype(np.int8).tobytes()],
            "bins": [bins.tobytes()],
            "margin": [np.zeros(len(ids)).tobytes()],
        })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= room:
                yield block(held)
                held = []
        if held:
            yield block(held)

    needed = df.select(
        F.col(row_id).cast("long").alias("ids"), F.col(label).cast("int").alias("label"),
        *[F.col(f).cast("double").alias(f) for f in edges],
    )
    return needed.mapInArrow(pack, BLOCK)


def _unpack(batch: pa.RecordBatch, n_features: int, wide: bool):
    """The blocks of a batch as arrays: ids (None where dropped), label, bins, margin."""
    kinds = {"ids": np.int64, "label": np.int8, "bins": np.uint16 if wide else np.uint8,
             "margin": np.float64}
    present = [c for c in kinds if c in batch.schema.names]
    for i in range(batch.num_rows):
        block = {c: np.frombuffer(batch[c][i].as_buffer(), kinds[c]) for c in present}
        yield (block.get("ids"), block["label"], block["bins"].reshape(n_features, -1),
               block["margin"])


def add_margin(blocks: DataFrame, tree: Tree, edges: Edges,
               base: float | None = None) -> DataFrame:
    """Blocks with the values of a tree added to their margins. With a ``base`` they carry
    ``loss`` too, the log loss of their rows summed."""
    n_features, wide = len(edges), _is_wide(edges)
    kept = [c for c in blocks.columns if c not in ("margin", "loss")]

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.asarray(tree.value)
        for batch in batches:
            margins, losses = [], []
            for _, label, bins, margin in _unpack(batch, n_features, wide):
                margin = margin + value[route(tree, bins)]
                margins.append(margin.tobytes())
                if base is not None:
                    losses.append(_log_loss(margin + base, label))
            added = [] if base is None else [pa.array(losses, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), pa.array(margins, pa.binary()), *added],
                names=[*kept, "margin", *(["loss"] if added else [])],
            )

    needed = blocks.select(*kept, "margin")
    schema = T.StructType(list(needed.schema))
    return needed.mapInArrow(update, schema if base is None else schema.add("loss", "double"))


def _log_loss(margin: np.ndarray, label: np.ndarray) -> float:
    p = np.clip(1.0 / (1.0 + np.exp(-margin)), CLIP, 1.0 - CLIP)
    return float(-np.sum(np.log(np.where(label > 0, p, 1.0 - p))))


def _is_wide(edges: Edges) -> bool:
    return max((len(c) for c in edges.values()), default=0) >= 256


def hashed(seed: int, *keys) -> np.ndarray:
    """Uniforms in [0, 1) that depend on (seed, keys) alone."""
    mixed = np.asarray(seed, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for key in keys:
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.asarray(key).astype(np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed = mixed ^ (mixed >> np.uint64(31))
    return (mixed >> np.uint64(11)).astype(float) / float(1 << 53)


def poisson_ceilings() -> np.ndarray:
    """Draws of a row in a large bootstrap sample follow Poisson(1): the chances of at most
    0, 1, ... of them, up to where doubles end."""
    return np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(19)])


def row_weights(growth: Growth, seed: int, ids: np.ndarray) -> np.ndarray | None:
    """How often a tree uses each row; None when every row counts once."""
    if not growth.bootstrap and growth.row_share >= 1.0:
        return None
    if growth.draws == "md5":
        drawn = literal_uniforms(seed, "rows", ids)
    else:
        drawn = hashed(seed, ids)
    if growth.bootstrap:
        return np.searchsorted(poisson_ceilings(), drawn, side="right").astype(float)
    return (drawn < growth.row_share).astype(float)


def offered_features(growth: Growth, seed: int, node: int, n_features: int) -> np.ndarray:
    """Mask of the features a node may split on: exact shares of a seeded order."""
    mask = np.ones(n_features, dtype=bool)
    features = np.arange(n_features)
    for share, keys in ((growth.tree_features, (1, features)),
                        (growth.node_features, (2, node, features))):
        if share < 1.0:
            allowed = np.flatnonzero(mask)
            keep = max(1, round(share * len(allowed)))
            order = allowed[np.argsort(hashed(seed, *keys)[allowed], kind="stable")]
            mask = np.isin(features, order[:keep])
    return mask


def level_sums(
    blocks: DataFrame, edges: Edges, growth: Growth, trees: dict[int, Tree],
    seeds: dict[int, int], open_nodes: dict[int, list[int]], features: range | None = None,
    offered: dict[tuple[int, int], np.ndarray] | None = None,
) -> DataFrame:
    """Histograms of the open nodes, one set per task: sums per bin as arrays of doubles,
    with row counts where cuts need a least number of rows."""
    n_features, wide = len(edges), _is_wide(edges)
    n_bins = _n_bins(edges)
    features = features or range(n_features)
    sides = _sides(growth)
    masks = {
        t: np.array([
            offered[t, n] if offered else offered_features(growth, seeds[t], n, n_features)
            for n in nodes])[:, features.start:features.stop]
        for t, nodes in open_nodes.items()
    }

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((len(sides), len(features), len(nodes) * n_bins))
                for t, nodes in open_nodes.items()}
        slots = {}
        for t, nodes in open_nodes.items():
            slots[t] = np.full(len(trees[t].feature), -1, dtype=np.int64)
            slots[t][nodes] = np.arange(len(nodes)) * n_bins
        for batch in batches:
            for ids, label, bins, margin in _unpack(batch, n_features, wide):
                p = margin + growth.base
                if growth.objective == "logistic":
                    p = 1.0 / (1.0 + np.exp(-p))
                grad, hess = p - label, p * (1.0 - p)
                if growth.objective == "mean":
                    hess = np.ones(len(p))
                for t, cells in sums.items():
                    # Only rows in nodes to sum are drawn and weighed.
                    at, g, h = slots[t][route(trees[t], bins)], grad, hess
                    here = np.flatnonzero(at >= 0)
                    some = len(here) < len(at)
                    weight = row_weights(
                        growth, seeds[t], ids[here] if some and ids is not None else ids)
                    if weight is not None and not weight.all():
                        kept = np.flatnonzero(weight)
                        here, weight, some = here[kept], weight[kept], True
                    if some:
                        at, g, h = at[here], g[here], h[here]
                    if weight is not None:
                        g, h = g * weight, h * weight
                    size = cells.shape[2]
                    for i in np.flatnonzero(masks[t].any(axis=0)):
                        own = bins[features[i]]
                        key = at + (own[here] if some else own)
                        cells[0, i] += np.bincount(key, weights=g, minlength=size)
                        cells[1, i] += np.bincount(key, weights=h, minlength=size)
                        if growth.min_rows:
                            cells[2, i] += np.bincount(key, minlength=size)
        for t, nodes in open_nodes.items():
            grid = sums[t].reshape(len(sides), len(features), len(nodes), n_bins)
            f, k = np.nonzero(masks[t].T)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(f), t), pa.int32()),
                    pa.array(np.asarray(nodes)[k], pa.int32()),
                    pa.array(f + features.start, pa.int32()),
                    *(pa.array([side[i, j].tobytes() for i, j in zip(f, k)], pa.binary())
                      for side in grid),
                ],
                names=["tree", "node", "feature", *sides],
            )

    return blocks.mapInArrow(add_up, _sums_schema(growth))


def needed_of(blocks: DataFrame, growth: Growth, tasks: int = 0) -> DataFrame:
    """The columns that sums need, in few tasks."""
    drawn = growth.bootstrap or growth.row_share < 1.0
    needed = ["label", "bins", "margin", *(["ids"] if drawn else [])]
    return blocks.select(*needed).coalesce(tasks or _map_tasks(blocks, 0, 0))


def _sides(growth: Growth) -> list[str]:
    return ["g", "h", *(["n"] if growth.min_rows else [])]


def _n_bins(edges: Edges) -> int:
    return 1 + max((len(c) for c in edges.values()), default=0)


def _sums_schema(growth: Growth) -> str:
    return SUMS + (", n binary" if growth.min_rows else "")


def _map_tasks(blocks: DataFrame, n_rows: int, n_features: int) -> int:
    """A histogram is as large for a small task as for a big one, so a small table has a
    few tasks per core; for a large one the data decide. (``coalesce`` never makes more
    tasks than there are partitions.)"""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return max(2 * cores, -(-n_rows * n_features // TASK_PAIRS))


def _sum_tasks(n_groups: int, n_bins: int, map_tasks: int) -> int:
    """Tasks to sum the histograms of all map tasks, some megabytes each."""
    volume = 16 * n_bins * n_groups * map_tasks
    return max(1, min(n_groups, volume // SUM_TASK_BYTES))


def _added(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int, int], np.ndarray]:
    """Sums per (tree, node, feature) of all histograms read."""
    sums: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("tree", "node", "feature")))
        for key, *sides in zip(keys, *batch.columns[3:]):
            cells = np.stack([np.frombuffer(side.as_buffer()) for side in sides])
            if key in sums:
                sums[key] += cells
            else:
                sums[key] = cells
    return sums


def in_lanes(partial: DataFrame, growth: Growth, groups: int, n_bins: int,
             map_tasks: int) -> DataFrame:
    """Histograms summed over lanes of map tasks, where these are many: a key then gets one
    histogram per lane instead of one per task."""
    if map_tasks <= ONE_STEP:
        return partial
    lanes = math.isqrt(map_tasks)
    sides = _sides(growth)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _sum_rows(_added(batches), sides)

    tasks = max(lanes, _sum_tasks(groups * lanes, n_bins, -(-map_tasks // lanes)))
    return (
        partial.withColumn("lane", F.spark_partition_id() % lanes)
        .repartition(tasks, "tree", "node", "feature", "lane").drop("lane")
        .mapInArrow(add, _sums_schema(growth))
    )


def best_cuts(partial: DataFrame, growth: Growth, tasks: int) -> DataFrame:
    """The best cut of every (tree, node) among the features a task has: one shuffle of the
    histograms to ``tasks``, so at most one row per node and task.

    Symmetric growth adds the gains of all open nodes first, so there the cut is the
    same for all nodes of a tree. Gains are whole multiples of 1e-9, and the lowest of
    equal features and bins wins, whatever the order of tasks.
    """
    shared = growth.policy == "symmetric"
    names = [c.split()[0] for c in CUTS.split(", ")]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _added(batches)
        groups: dict[tuple[int, ...], list] = {}
        for tree, node, feature in sorted(sums):
            group = (tree, feature) if shared else (tree, feature, node)
            groups.setdefault(group, []).append((node, sums[tree, node, feature]))
        best: dict[tuple[int, int], tuple] = {}
        for (tree, feature, *_), entries in sorted(groups.items(), key=lambda g: g[0]):
            nodes = [node for node, _ in entries]
            below = np.cumsum(np.stack([cells for _, cells in entries], axis=1), axis=2)
            for row in _cut_rows(tree, feature, nodes, below, growth, shared):
                if row[:2] not in best or row[4] > best[row[:2]][4]:
                    best[row[:2]] = row
        columns = zip(*best.values()) if best else [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32() if i < 4 else pa.float64()) for i, c in enumerate(columns)],
            names=names,
        )

    keys = ["tree", "feature"] if shared else ["tree", "node", "feature"]
    return partial.repartition(tasks, *keys).mapInArrow(choose, CUTS)


def cell_rows(partial: DataFrame, growth: Growth) -> DataFrame:
    """Histograms as rows: sums per (tree, node, feature, bin) over all tasks."""
    sides = _sides(growth)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, node, feature), cells in _added(batches).items():
            size = cells.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.full(size, v), pa.int32()) for v in (tree, node, feature)),
                 pa.array(np.arange(size), pa.int32()), *map(pa.array, cells)],
                names=["tree", "node", "feature", "bin", *sides],
            )

    schema = "tree int, node int, feature int, bin int, " + ", ".join(
        f"{s} double" for s in sides)
    return partial.mapInArrow(spread, schema).groupBy("tree", "node", "feature", "bin").agg(
        *[F.sum(s).alias(s) for s in sides])


def _gains(below: np.ndarray, growth: Growth, shared: bool) -> np.ndarray:
    """Gain of a cut after every bin, from running sums ``below[side, node, ..., bin]``.
    Cuts shared by all nodes have their gains added up."""
    gl, hl = below[:2]
    gt, ht = gl[..., -1:], hl[..., -1:]

    def term(g, h):
        full = h + growth.l2
        return np.divide(g * g, full, out=np.zeros_like(g), where=full > 0)

    gain = 0.5 * (term(gl, hl) + term(gt - gl, ht - hl) - term(gt, ht))
    if shared:
        gain = np.broadcast_to(gain.sum(axis=0), gain.shape)
    else:
        least = np.maximum(growth.min_child, ht * 1e-9)
        gain = np.where((hl >= least) & (ht - hl >= least), gain, -1.0)
        if growth.min_rows:
            nl, nt = below[2], below[2][..., -1:]
            gain = np.where(
                (nl >= growth.min_rows) & (nt - nl >= growth.min_rows), gain, -1.0)
    return np.rint(gain * 1e9) / 1e9


def _cut_rows(tree, feature, nodes, below, growth: Growth, shared: bool) -> list[tuple]:
    """Best cut rows of nodes that are decided together; ``below[side, node, bin]`` runs on."""
    gain, (gl, hl) = _gains(below, growth, shared), below[:2]
    bins = gain.argmax(axis=1)
    return [
        (tree, n, feature, int(b), gain[i, b], gl[i, b], hl[i, b], gl[i, -1], hl[i, -1])
        for i, (n, b) in enumerate(zip(nodes, bins))
    ]


def summed_up(partial: DataFrame, growth: Growth, tasks: int) -> DataFrame:
    """Histograms of all tasks added: one row per (tree, node, feature)."""
    sides = _sides(growth)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _sum_rows(_added(batches), sides)

    return partial.repartition(tasks, "tree", "node", "feature").mapInArrow(
        add, _sums_schema(growth))


def _sum_rows(sums: dict[tuple[int, int, int], np.ndarray], sides: list[str]) -> pa.RecordBatch:
    keys = list(zip(*sums)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(k, pa.int32()) for k in keys),
         *(pa.array([cells[i].tobytes() for cells in sums.values()], pa.binary())
           for i in range(len(sides)))],
        names=["tree", "node", "feature", *sides],
    )


# Histograms [side, feature, bin] of nodes by (tree, node), and the features they have.
Pool = dict[tuple[int, int], np.ndarray]


def _best_of_pool(pool: Pool, offered: dict[tuple[int, int], np.ndarray], growth: Growth
                  ) -> dict[tuple[int, int], Split]:
    """The best splits of all nodes of a pool: :func:`best_cuts` where they are few."""
    found = {}
    shared = growth.policy == "symmetric"
    trees: dict[int, list[int]] = {}
    for t, node in sorted(pool):
        trees.setdefault(t, []).append(node)
    for t, nodes in trees.items():
        below = np.cumsum(np.stack([pool[t, n] for n in nodes], axis=1), axis=-1)
        gains = _gains(below, growth, shared)
        for i, node in enumerate(nodes):
            gain = np.where(offered[t, node][:, None], gains[i], -np.inf)
            feature, b = divmod(int(gain.argmax()), gain.shape[1])
            (gl, hl), (gt, ht) = below[:2, i, feature, b], below[:2, i, feature, -1]
            found[t, node] = Split(float(gain[feature, b]), feature, b, float(gl), float(hl),
                                   float(gt), float(ht))
    return found


Portion = tuple[dict[int, list[int]], range]


def _portions(open_nodes: dict[int, list[int]], n_features: int, n_bins: int) -> Iterator[Portion]:
    """Open nodes in portions whose histograms stay within ``MAX_CELLS``: as many nodes as
    fit with all features, or one node with some of them."""
    room, wide = MAX_CELLS // (n_features * n_bins), max(1, MAX_CELLS // n_bins)
    portion: dict[int, list[int]] = {}
    used = 0
    for t, nodes in open_nodes.items():
        for n in nodes:
            if not room:
                for first in range(0, n_features, wide):
                    yield {t: [n]}, range(first, min(first + wide, n_features))
                continue
            if used == room:
                yield portion, range(n_features)
                portion, used = {}, 0
            portion.setdefault(t, []).append(n)
            used += 1
    if portion:
        yield portion, range(n_features)


class Levels:
    """The best splits of open nodes, level by level, one job each.

    Up to ``POOL_CELLS`` cells, histograms come to the driver, where a pool keeps those
    of the last level. Of two children only the one with less weight is then summed over the
    rows; the other one's histogram is its parent's less that. (Nodes that draw features of
    their own are all summed, over those features alone.) Larger levels are summed and cut
    in tasks, and only the cuts come to the driver.
    """

    def __init__(self, blocks: DataFrame, edges: Edges, growth: Growth, seeds: dict[int, int],
                 n_rows: int = 0) -> None:
        self.edges, self.growth, self.seeds = edges, growth, seeds
        self.map_tasks = _map_tasks(blocks, n_rows, len(edges))
        self.blocks = needed_of(blocks, growth, self.map_tasks)
        self.cores = blocks.sparkSession.sparkContext.defaultParallelism
        self.pool: Pool = {}
        self.summed: list[tuple[int, int]] = []  # nodes summed over rows, and open ones, by level

    def _shares(self, trees: dict[int, Tree], open_nodes: dict[int, list[int]],
                weight: dict[tuple[int, int], tuple[float, float]]
                ) -> tuple[dict[int, list[int]], dict[tuple[int, int], tuple[int, int]]]:
        """Open nodes to sum over the rows, and those to derive: (tree, big child) with
        (parent, small child)."""
        summed, derived = {t: list(nodes) for t, nodes in open_nodes.items()}, {}
        if self.growth.node_features < 1.0:
            return summed, derived
        for t, parent in self.pool:
            left, right = trees[t].left[parent], trees[t].right[parent]
            if {left, right} <= set(open_nodes.get(t, ())):
                small = left if weight[t, left][1] <= weight[t, right][1] else right
                big = left + right - small
                summed[t].remove(big)
                derived[t, big] = (parent, small)
        return summed, derived

    def find(self, trees: dict[int, Tree], open_nodes: dict[int, list[int]],
             weight: dict[tuple[int, int], tuple[float, float]] | None = None
             ) -> dict[tuple[int, int], Split]:
        """Splits of the open nodes; ``weight`` has the gradient sums of those whose parents
        are in the pool."""
        n_features, n_bins = len(self.edges), _n_bins(self.edges)
        summed, derived = self._shares(trees, open_nodes, weight or {})
        n_open, n_summed = (sum(map(len, d.values())) for d in (open_nodes, summed))
        self.summed.append((n_summed, n_open))
        offered = {
            (t, n): offered_features(self.growth, self.seeds[t], n, n_features)
            for t, nodes in open_nodes.items() for n in nodes}
        groups = n_features * n_summed
        if groups * n_bins > POOL_CELLS or n_features * n_open * n_bins > MAX_CELLS:
            self.pool = {}
            return self._find_in_tasks(trees, open_nodes)
        partial = level_sums(
            self.blocks, self.edges, self.growth, trees, self.seeds, summed, offered=offered)
        if self.map_tasks * groups * n_bins > DIRECT_CELLS:
            lanes = in_lanes(partial, self.growth, groups, n_bins, self.map_tasks)
            tasks = min(groups, max(self.cores, self._sum_tasks(groups)))
            partial = summed_up(lanes, self.growth, tasks)
        rows = partial.toArrow()
        pool = {(t, n): np.zeros((len(_sides(self.growth)), n_features, n_bins))
                for t, nodes in open_nodes.items() for n in nodes}
        for (t, n, feature), cells in _added(rows.to_batches()).items():
            pool[t, n][:, feature] = cells
        for (t, big), (parent, small) in derived.items():
            pool[t, big] = self.pool[t, parent] - pool[t, small]
        self.pool = pool
        return _best_of_pool(pool, offered, self.growth)

    def _sum_tasks(self, groups: int) -> int:
        each = math.isqrt(self.map_tasks) if self.map_tasks > ONE_STEP else self.map_tasks
        return _sum_tasks(groups, _n_bins(self.edges), each)

    def _find_in_tasks(self, trees, open_nodes) -> dict[tuple[int, int], Split]:
        n_features, n_bins = len(self.edges), _n_bins(self.edges)
        parts = [
            level_sums(self.blocks, self.edges, self.growth, trees, self.seeds, nodes, features)
            for nodes, features in _portions(open_nodes, n_features, n_bins)
        ]
        groups = n_features * sum(map(len, open_nodes.values()))
        partial = in_lanes(reduce(DataFrame.unionByName, parts), self.growth, groups, n_bins,
                           self.map_tasks)
        # One row per open node and task.
        found: dict[tuple[int, int], Split] = {}
        rows = best_cuts(partial, self.growth, self._sum_tasks(groups)).collect()
        for r in sorted(rows, key=lambda r: r["feature"]):
            key = (r["tree"], r["node"])
            if key not in found or r["gain"] > found[key].gain:
                found[key] = Split(r["gain"], r["feature"], r["bin"], r["gl"], r["hl"],
                                   r["gt"], r["ht"])
        return found


def _chosen(tree: Tree, splits: dict[int, Split], limit: int) -> list[int]:
    """Nodes to split, best gain first, until the tree has ``limit`` leaves."""
    heap = [(-splits[0].gain, 0)] if 0 in splits else []
    order: list[int] = []
    while heap and len(order) < limit - 1:
        _, node = heapq.heappop(heap)
        order.append(node)
        for child in (tree.left[node], tree.right[node]):
            if child in splits:
                heapq.heappush(heap, (-splits[child].gain, child))
    return order


def _split_level(
    trees: dict[int, Tree], splits: dict[tuple[int, int], Split], level: int, growth: Growth,
    known: dict[int, dict[int, Split]], sums: dict[tuple[int, int], tuple[float, float]],
    limit: int,
) -> dict[int, list[int]]:
    """Split the nodes of a level; the children that are open next."""
    opened: dict[int, list[int]] = {}
    for (t, node), split in sorted(splits.items()):
        sums[t, node] = (split.gt, split.ht)
        if split.gain <= 0:
            continue
        tree = trees[t]
        left, right = tree.split(node, split.feature, split.bin)
        tree.depth = level + 1
        known[t][node] = split
        sums[t, left] = (split.gl, split.hl)
        sums[t, right] = (split.gt - split.gl, split.ht - split.hl)
        opened.setdefault(t, []).extend([left, right])
    if growth.policy == "leaf":
        for t, nodes in list(opened.items()):
            reached = set(_chosen(trees[t], known[t], limit))
            tree = trees[t]
            kids = {c for n in reached for c in (tree.left[n], tree.right[n])}
            opened[t] = [n for n in nodes if n in kids]
    return {t: nodes for t, nodes in opened.items() if nodes}


def grow_trees(
    blocks: DataFrame, edges: Edges, growth: Growth, seeds: dict[int, int], n_rows: int = 0
) -> dict[int, Tree]:
    """Grow one tree per seed, all of them level by level in the same jobs.

    Leaf-wise growth also goes by levels: a node the best-first order would not
    reach with the splits known so far cannot be reached later, so only children
    of reachable nodes stay open, and the final order is taken once all are known.
    """
    levels = Levels(blocks, edges, growth, seeds, n_rows)
    trees = {t: Tree() for t in seeds}
    sums: dict[tuple[int, int], tuple[float, float]] = {}
    known: dict[int, dict[int, Split]] = {t: {} for t in seeds}
    limit = growth.num_leaves or 2**growth.max_depth
    open_nodes = {t: [0] for t in seeds}
    for level in range(growth.max_depth):
        splits = levels.find(trees, open_nodes, sums)
        open_nodes = _split_level(trees, splits, level, growth, known, sums, limit)
        if not open_nodes:
            break
    if growth.policy == "leaf":
        trees = {t: _keep(trees[t], _chosen(trees[t], known[t], limit), sums, t) for t in trees}
    for t, tree in trees.items():
        for n, f in enumerate(tree.feature):
            if f < 0:
                g, h = sums.get((t, n), (0.0, 0.0))
                tree.value[n] = -growth.shrink * g / (h + growth.l2) if h + growth.l2 > 0 else 0.0
    return trees


def _keep(tree: Tree, order: list[int], sums: dict, t: int) -> Tree:
    """The tree with only the given splits, nodes numbered in the order they were split."""
    kept, number, moved = Tree(), {0: 0}, {}
    moved[0] = sums.get((t, 0), (0.0, 0.0))
    deep = {0: 0}
    for node in order:
        children = kept.split(number[node], tree.feature[node], tree.cut[node])
        for old, new in zip((tree.left[node], tree.right[node]), children):
            number[old], deep[new] = new, deep[number[node]] + 1
            moved[new] = sums[t, old]
    kept.depth = max(deep.values())
    for key in [k for k in sums if k[0] == t]:
        del sums[key]
    sums.update({(t, n): s for n, s in moved.items()})
    return kept


def cached(blocks: DataFrame) -> DataFrame:
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)
