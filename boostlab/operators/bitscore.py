"""Scoring large ensembles by bit vectors.

The leaves of a tree are the bits of a mask, from left to right. A row that fails the test of
a node (its bin is above the cut) cannot end in the node's left subtree, so those bits are
cleared; the lowest bit left is the row's leaf. Which bits the nodes of one feature clear
depends on the row's bin alone: per tree and feature there is one table of masks by bin,
whose cuts are cleared in ascending order. A tree then costs one lookup per feature it tests,
all over contiguous arrays, and no walk from level to level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from boostlab.operators.model import Tree, route

#: Leaves of a word, and words up to which masks are quicker than walking.
WORD, MOST_WORDS = 64, 2
#: Rows looked up at once, so that masks and bins stay in the processor's cache.
ROWS = 8192
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class _Masks:
    """A tree as tables ``[bin]`` of masks by (word, feature), and its leaf values in order."""

    tables: list[dict[int, np.ndarray]]
    values: np.ndarray


def _leaves(tree: Tree) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Leaves from left to right, and the span of every inner node's left subtree."""
    leaves: list[int] = []
    spans: dict[int, tuple[int, int]] = {}
    todo: list[tuple[int, int | None]] = [(0, None)]  # node, and its first leaf once left is done
    while todo:
        node, first = todo.pop()
        if tree.feature[node] < 0:
            leaves.append(node)
        elif first is None:
            todo += [(node, len(leaves)), (tree.left[node], None)]
        else:
            spans[node] = (first, len(leaves))
            todo.append((tree.right[node], None))
    return leaves, spans


def _masks(tree: Tree, n_bins: int) -> _Masks | None:
    """The tree's tables; None for one of so many leaves that walking is quicker."""
    leaves, spans = _leaves(tree)
    n_words = -(-len(leaves) // WORD)
    if n_words > MOST_WORDS:
        return None
    tables: list[dict[int, np.ndarray]] = [{} for _ in range(n_words)]
    for node, (first, end) in spans.items():
        for word in range(first // WORD, -(-end // WORD)):
            low, high = max(first - word * WORD, 0), min(end - word * WORD, WORD)
            if low >= high:
                continue
            cleared = _ALL ^ np.uint64(((1 << high) - 1) ^ ((1 << low) - 1))
            table = tables[word].setdefault(
                tree.feature[node], np.full(n_bins, _ALL, dtype=np.uint64))
            table[tree.cut[node] + 1:] &= cleared
    last = len(leaves) - (n_words - 1) * WORD
    if last < WORD:  # bits that are no leaves
        tables[-1][-1] = np.array([(1 << last) - 1], dtype=np.uint64)
    return _Masks(tables, np.asarray(tree.value)[leaves])


class BitTrees:
    """An ensemble prepared for scoring; trees too large for masks are walked."""

    def __init__(self, trees: list[Tree], n_bins: int) -> None:
        self.trees = [(tree, _masks(tree, n_bins)) for tree in trees]

    def totals(self, bins: np.ndarray) -> np.ndarray:
        """Tree values added up, in order, per row of ``bins[feature, row]``."""
        n = bins.shape[1]
        out = np.zeros(n)
        for at in range(0, n, ROWS):
            out[at:at + ROWS] = self._block(bins[:, at:at + ROWS])
        return out

    def _block(self, bins: np.ndarray) -> np.ndarray:
        n = bins.shape[1]
        places = bins.astype(np.intp)
        total, looked_up = np.zeros(n), np.empty(n, dtype=np.uint64)
        for tree, masks in self.trees:
            if masks is None:
                total += np.asarray(tree.value)[route(tree, bins)]
                continue
            leaf = np.zeros(n, dtype=np.int64)
            open_ = None  # rows whose leaf is not in the words before
            for number, tables in enumerate(masks.tables):
                mask = np.full(n, _ALL, dtype=np.uint64)
                for feature, table in tables.items():
                    if feature < 0:
                        mask &= table[0]
                    else:
                        table.take(places[feature], out=looked_up, mode="clip")
                        mask &= looked_up
                bit = np.frexp((mask & (~mask + np.uint64(1))).astype(float))[1] - 1
                if len(masks.tables) == 1:
                    leaf = bit
                    break
                here = mask != 0 if open_ is None else open_ & (mask != 0)
                leaf[here] = number * WORD + bit[here]
                open_ = ~here if open_ is None else open_ & ~here
            total += masks.values.take(leaf)
        return total
