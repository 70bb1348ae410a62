import random

import pytest
from boostlab.llm import near_dedup


def sets_of(rows):
    out = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        size = min(5, len(words))
        out.append((i, {tuple(words[a:a + size]) for a in range(len(words) - size + 1)}
                    if size else set()))
    return out


def brute(rows):
    sets = sets_of(rows)
    top = {i: i for i, _ in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1:]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((root(i), root(j)))
                top[high] = low
    return sorted((i, len(s), root(i), i == root(i)) for i, s in sets)


def found(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                  for r in df.collect())


def near_copies(seed, n):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(8, 120))] for _ in range(6)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 9999)}"
        if rng.random() < 0.3:
            words = passage + words[:rng.randint(0, 30)]
        rows.append((i * 3 % 1009, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs_of, seed):
    rows = near_copies(seed, 150)
    assert found(near_dedup.near_duplicates(docs_of(rows))) == brute(rows)


def test_whole_table(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    result = found(near_dedup.near_duplicates(sample))
    assert result == brute(rows)
    assert any(not kept for *_, kept in result)


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One\ttwo "), (6, "two one"),
            (7, "a b c d e f g h " * 2000), (8, "a b c d e f g h " * 1999), (9, "a b c d e"),
            (9, "a b c d e")]
    want = brute(rows[:-1]) + [(9, 1, 9, True)]
    assert found(near_dedup.near_duplicates(docs_of(rows))) == sorted(want)
    null = near_dedup.near_duplicates(docs_of([(None, "one two"), (4, "one two")])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in null} == {
        (None, None, True), (4, 4, True)}


def test_empty_table(docs_of):
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["rep"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_rest_of_mixed_buckets_is_found(docs_of, monkeypatch):
    """Even when every first pair is taken away, the exact second step finds all links."""
    rows = near_copies(3, 120)
    first = near_dedup._first_pairs
    monkeypatch.setattr(near_dedup, "_first_pairs", lambda c: first(c).filter("false"))
    assert found(near_dedup.near_duplicates(docs_of(rows))) == brute(rows)


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """op3_near_duplicates: a table is written for the nodes alone, none for links."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(50, 51)] * 2, "a long, b long")
    written = []
    monkeypatch.setattr(near_dedup, "settled", lambda df, f=near_dedup.settled: (
        written.append(df.columns), f(df))[1])
    got = sorted(map(tuple, near_dedup.components(edges).collect()))
    assert got == [(i, 0) for i in range(40)] + [(50, 50), (51, 50)]
    assert len(written) == 1


def test_components_of_random_links(spark):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    top = list(range(300))
    for a, b in links:
        low, high = sorted((top[a], top[b]))
        top = [low if t == high else t for t in top]
    edges = spark.createDataFrame(links, "a long, b long")
    got = sorted(map(tuple, near_dedup.components(edges).collect()))
    assert got == [(i, top[i]) for i in sorted({i for a, b in links if a != b for i in (a, b)})]


def test_later_links_join_components_alone(docs_of, monkeypatch):
    """op3_near_duplicates: links found last are merged without those found first."""
    rows = near_copies(3, 120)
    first, merged = near_dedup._first_pairs, near_dedup.components
    calls = []

    def seen(edges):
        calls.append((edges.collect(), out := merged(edges)))
        return out

    monkeypatch.setattr(near_dedup, "_first_pairs", lambda c: first(c).filter("(a + b) % 3 = 0"))
    monkeypatch.setattr(near_dedup, "components", seen)
    assert found(near_dedup.near_duplicates(docs_of(rows))) == brute(rows)
    own = {r["rep"]: r["component"] for r in calls[0][1].collect()}
    assert own and calls[-1][0] and len(calls) == 3
    assert all(own.get(i, i) == i for e in calls[-1][0] for i in e)
