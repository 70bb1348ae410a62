import numpy as np
import pytest

from boostlab.operators import bitscore, model

BINS, WIDTH = 256, 12


def grown(leaves, seed, lopsided):
    """A tree of random tests, balanced or as lopsided as can be."""
    draw = np.random.default_rng(seed)
    tree, open_ = model.Tree(), [(0, 0)]
    for _ in range(leaves - 1):
        node, depth = open_.pop(-1 if lopsided else 0)
        children = tree.split(node, int(draw.integers(WIDTH)), int(draw.integers(BINS - 1)))
        open_ += [(c, depth + 1) for c in children]
        tree.depth = max(tree.depth, depth + 1)
    tree.value = draw.normal(size=len(tree.feature)).tolist()
    return tree


def walked(trees, bins):
    total = np.zeros(bins.shape[1])
    for tree in trees:
        total += np.asarray(tree.value)[model.route(tree, bins)]
    return total


@pytest.mark.parametrize("lopsided", [False, True])
@pytest.mark.parametrize("leaves", [1, 2, 3, 63, 64, 65, 100, 128, 129])
def test_leaves_are_those_of_a_walk(leaves, lopsided):
    """One word, several words, and trees that are too large for words."""
    trees = [grown(leaves, seed, lopsided) for seed in range(3)]
    bins = np.random.default_rng(9).integers(0, BINS, (WIDTH, 20_000), dtype=np.uint8)
    assert np.array_equal(bitscore.BitTrees(trees, BINS).totals(bins), walked(trees, bins))


@pytest.mark.parametrize("nodes", [255, 10_000, 100_000])
def test_ensembles_of_many_nodes(nodes):
    trees = [grown(64, seed, False) for seed in range(-(-nodes // 127))]
    bins = np.random.default_rng(9).integers(0, BINS, (WIDTH, 3000), dtype=np.uint8)
    assert np.array_equal(bitscore.BitTrees(trees, BINS).totals(bins), walked(trees, bins))


def test_scores_of_a_table(spark, monkeypatch):
    """The expression, the walk and the masks agree, missing values included."""
    features = [f"f{i}" for i in range(WIDTH)]
    edges = {f: [float(i) for i in range(BINS - 1)] for f in features}
    fitted = model.TreeModel(features, edges, [grown(40, seed, False) for seed in range(3)], 0.1)
    draw = np.random.default_rng(3)
    rows = [(i, *(None if draw.random() < 0.05 else float(draw.uniform(-5, 260))
                  for _ in features)) for i in range(500)]
    df = spark.createDataFrame(rows, ["row_id", *features])
    monkeypatch.setattr(model, "BIT_ROWS", 0)
    found = []
    for most in (10**6, 0):  # an expression, then masks
        monkeypatch.setattr(model, "EXPRESSION_NODES", most)
        found.append({r["row_id"]: r["proba"] for r in model.score(df, fitted).collect()})
    assert found[0] == pytest.approx(found[1], abs=1e-12)
