import hashlib
import random
import zlib

import numpy as np
import pytest
from boostlab.llm import runs
from boostlab.llm.queries import QUERIES


def by_force(words, least_words=24, least_periods=3):
    """Every period in turn: stretches that it covers and nothing extends."""
    best = {}
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_words, least_periods * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    found = ((start, end - start, q) for (start, end), q in best.items())
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(seed, n):
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        kinds, size = draw.choice([1, 2, 3, 5, 50]), draw.choice([0, 1, 5, 23, 24, 25, 60, 200])
        text = [draw.randrange(kinds) for _ in range(size)]
        for _ in range(draw.randrange(3) if size else 0):
            period, start = draw.randrange(1, 9), draw.randrange(size)
            for i in range(start + period, min(size, start + draw.randrange(80))):
                text[i] = text[i - period]
        texts.append(text)
    return texts


@pytest.mark.parametrize("least_words,least_periods", [(24, 3), (6, 3), (5, 2), (8, 4)])
def test_runs_of_random_texts(least_words, least_periods):
    texts = some_texts(least_words, 800)
    for at in range(0, len(texts), 5):
        some = texts[at:at + 5]
        got = runs.runs_of([np.array(t, dtype=np.int64) for t in some], least_words, least_periods)
        assert got == [by_force(t, least_words, least_periods) for t in some]


def test_colliding_hashes_change_nothing(monkeypatch):
    """The hashes may keep a text too many, never one too few."""
    monkeypatch.setattr(runs, "_alike", lambda words, depth: np.arange(len(words) - depth + 1))
    texts = some_texts(9, 100)
    got = runs.runs_of([np.array(t, dtype=np.int64) for t in texts])
    assert got == [by_force(t) for t in texts]


def test_long_texts_stay_quick():
    one = runs.runs_of([np.zeros(150_000, dtype=np.int64), np.tile(np.arange(900), 150)])
    assert one == [[(0, 150_000, 1)], [(0, 135_000, 900)]]


def test_places_keep_their_order(monkeypatch):
    monkeypatch.setattr(runs, "PART", 4)
    order = list(range(300))
    random.Random(2).shuffle(order)
    places, seen = runs.Places(order[0]), [order[0]]
    for place in order[1:]:
        below, above = [x for x in seen if x < place], [x for x in seen if x > place]
        assert places.enter(place) == (max(below, default=-1), min(above, default=-1))
        seen.append(place)
    assert list(places) == sorted(order) and max(map(len, places.parts)) <= 9


ODD = [None, "", " \t\n\x0b\x0c\r", "one", "a " * 24, "a " * 23, "a\x1cb " * 30, "x y\n" * 300,
       "é  ü\t" * 12 + "z", "a b c " * 8 + "a b", "w\xa0v " * 24, "A a " * 40, "q " * 40_000]


def test_odd_rows(docs_of):
    rows = [*enumerate(ODD), (4, ODD[4]), (None, "n " * 30)]
    want = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        found = by_force(words) if len(words) < 1000 else [(0, len(words), 1)]
        want.append((str(i), len(words), found, collapsed(words, found)))
    got = [(str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
           for r in runs.find_runs(docs_of(rows)).collect()]
    assert sorted(got) == sorted(want)


def test_small_batches(docs_of, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 1)
    assert runs.find_runs(docs_of([*enumerate(ODD)])).count() == len(ODD)


def test_empty_table(docs_of):
    assert runs.find_runs(docs_of([])).count() == 0


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_force(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, found).encode()).hexdigest())


def test_query_by_force(spark, sf_dir, sample):
    short = [r for r in sample.collect() if len(r["text"] or "") < 6000]
    want = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in short}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == sample.count() and len(want) > 100
    assert {i: got[i] for i in want} == want
    assert sum(row[1] > 0 for row in want.values()) > 5
