import math
import random

import numpy as np
import pytest
from boostlab.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, row long, a int, c int, score double"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 0.5) for r in rows], SCHEMA)


def whole(x):
    return math.floor(256 * x) if abs(x) < 2.0 ** 60 else 256 * int(x)


def by_force(rows, positives=5, negatives=3):
    kept = [(i, label, [whole(x) for x in v]) for i, label, v in rows
            if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for own, label, v in kept:
        if own % 50:
            continue
        ranked = sorted((-score(v, w), i, other == label) for i, other, w in kept)
        best = [(i, -s) for s, i, same in ranked if same and i != own][:positives]
        for positive, p in best:
            fit = [(i, -s) for s, i, same in ranked
                   if not same and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(own, positive, rank, i, p, n) for rank, (i, n) in enumerate(fit, 1)]
    return sorted((*r[:4], *(max(-2**63, min(2**63 - 1, s)) for s in r[4:])) for r in out)


def found(df, **settings):
    return sorted(tuple(r) for r in hard_negatives.mine(df, **settings).collect())


def drawn(seed, n, size, scale=0.5, steps=None):
    draw = random.Random(seed)

    def value():
        x = draw.uniform(-scale, scale)
        return round(x * steps) / steps if steps else x

    return [(i, draw.randrange(3), [value() for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"anchors": 2, "candidates": 50}])
def test_like_brute_force(spark, blocks):
    rows = drawn(1, 400, 6)
    assert found(table(spark, rows), **blocks) == by_force(rows) != []


def test_many_ties(spark):
    rows = drawn(2, 300, 2, steps=4)
    assert found(table(spark, rows), candidates=40) == by_force(rows) != []


@pytest.mark.parametrize("scale", [1e3, 1e6, 1e12, 1e300])
def test_components_of_any_size(spark, scale):
    rows = drawn(3, 120, 4, scale=scale)
    assert found(table(spark, rows)) == by_force(rows) != []


def test_odd_rows(spark):
    rows = drawn(4, 200, 5)
    rows[3] = (3, None, rows[3][2])
    rows[4] = (4, 1, None)
    rows[50] = (50, 1, [0.1, None, 0.2, 0.3, 0.4])
    rows[51] = (51, 1, [0.1, NAN, 0.2, 0.3, 0.4])
    rows[52] = (52, 1, [0.1, -INF, 0.2, 0.3, 0.4])
    rows[53] = (None, 1, rows[53][2])
    rows[54] = (54, 1, [])
    rows[55] = (55, 1, [0.4])
    rows[56] = (-50, 1, rows[56][2])
    rows += [rows[7], rows[100], rows[100]]
    assert found(table(spark, rows)) == by_force(rows)


def test_empty_and_single(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(0, 1, [0.5])])) == []


@pytest.mark.parametrize("most", [1, 200, 4000, 2**40, 2**90])
def test_fields_hold_every_product(most):
    draw = random.Random(most)
    kind = np.int64 if most < 2**24 else object
    a, c = (np.array([[draw.choice([-most, most, draw.randint(-most, most)]) for _ in range(9)]
                      for _ in range(n)], dtype=kind) for n in (5, 131))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in c] for u in a]
    assert hard_negatives.products(a, c).tolist() == want


def test_a_word_holds_several_candidates(monkeypatch):
    """Both ways multiply an anchor's component once for all the fields of a word."""
    a, c = np.ones((2, 3), dtype=np.int64), np.ones((10, 3), dtype=np.int64)
    seen = []
    real = hard_negatives._by_doubles
    monkeypatch.setattr(hard_negatives, "_by_doubles",
                        lambda *args: seen.append(args[3]) or real(*args))
    assert hard_negatives.products(a, c).tolist() == [[3] * 10] * 2
    assert seen == [26]
