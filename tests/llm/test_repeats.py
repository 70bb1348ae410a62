import hashlib
import random
from collections import Counter

import pytest
from boostlab.llm import repeats


def brute(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[a:a + length] for _, r in raws for a in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for a in range(len(r) - length + 1):
            if seen[r[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                   for r in df.collect()), key=str)


def made_up(seed, n, alphabet="ab", size=120):
    rng = random.Random(seed)
    shared = ["".join(rng.choices(alphabet, k=rng.randint(10, 60))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        while sum(map(len, parts)) < rng.randint(0, size):
            parts.append(rng.choice(shared) if rng.random() < 0.5
                         else "".join(rng.choices(alphabet, k=rng.randint(1, 40))))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,alphabet,length,gram,hot", [
    (1, "ab", 20, 8, 2000), (2, "abcdefgh", 24, 6, 2000), (3, "abcdefgh", 24, 6, 2),
    (4, "ab", 20, 8, 2), (5, "añb ", 16, 4, 3),
])
def test_against_brute_force(docs_of, seed, alphabet, length, gram, hot):
    rows = made_up(seed, 60, alphabet)
    df = repeats.remove_repeats(docs_of(rows), length=length, gram=gram, hot=hot)
    assert found(df) == brute(rows, length)


def test_odd_rows(docs_of):
    line = "a common line of some sixty bytes stands in every document.\n"
    rows = [(1, None), (2, ""), (3, "z" * 2000), (4, "short"), (5, "x" + "y" * 399),
            (6, "long " * 400), (6, "long " * 400), (None, "q" * 399), (None, None)]
    rows += [(10 + i, f"{i * 7919} " * 60 + line + f"{i * 104729} " * 60) for i in range(8)]
    assert found(repeats.remove_repeats(docs_of(rows))) == brute(rows, 400)
    assert found(repeats.remove_repeats(docs_of(rows), hot=2)) == brute(rows, 400)


def test_whole_table(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    assert found(repeats.remove_repeats(sample)) == brute(rows, 400)


def test_empty_table(docs_of):
    assert repeats.remove_repeats(docs_of([])).count() == 0


def test_stretches_of_a_long_text(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 64)
    raw = b"".join(str(i * i).encode() for i in range(300))
    keys = set()
    for anchors, starts, windows, pivots in repeats.segments_of(raw, 40, 8):
        assert (pivots >= 0).all() and (pivots <= 32).all()
        keys.update(p for s, w in zip(starts.tolist(), windows.tolist())
                    for p in range(s, s + w))
    assert keys == set(range(len(raw) - 39))


def test_groups_hold_all_occurrences_and_are_maximal():
    texts = [b"xxabcdefgh1", b"yyabcdefgh2", b"zzabcdefgh3", b"qqabcdefgh1"]
    groups = {(size, tuple(sorted(places))) for size, places in repeats.repeat_groups(texts, 6)}
    assert (8, ((0, 2), (1, 2), (2, 2), (3, 2))) in groups  # all four, not just neighbours
    assert (9, ((0, 2), (3, 2))) in groups
    assert all(place == 2 for _, places in groups for _, place in places)
