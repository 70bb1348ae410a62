"""Near copies among rows that share an id."""

import pytest
from boostlab.llm import near_dedup
from test_near_dedup import near_copies, sets_of


@pytest.mark.parametrize("seed", [4, 5])
def test_near_copies_of_an_id_with_different_texts(docs_of, seed):
    """op3_near_duplicates compares every text of an id."""
    rows = [(i % 40, t) for i, t in near_copies(seed, 120)]
    sets = [s for _, s in sets_of(rows)]
    part = list(range(len(rows)))
    for x, a in enumerate(sets):
        for y in range(x):
            b = sets[y]
            if part[x] != part[y] and 100 * len(a & b) >= 75 * len(a | b):
                part = [part[y] if p == part[x] else p for p in part]
    least = {}
    for (i, _), p in zip(rows, part):
        least[p] = min(i, least.get(p, i))
    want = sorted((i, len(s), least[p], i == least[p]) for (i, _), s, p in zip(rows, sets, part))
    got = near_dedup.near_duplicates(docs_of(rows)).collect()
    assert sorted(map(tuple, got)) == want
