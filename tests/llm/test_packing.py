import zlib

import numpy as np
import public_tokenizers
import pytest
from boostlab.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t\n", "Hello, WORLD!! it's 42", "<|endoftext|> a<|startoftext|>b",
       "x\x1cy\x85z\xa0w", "ÉCOLE Straße İstanbul J̌ ΣΑΣ", "a_b__c ---''s ½²", "日本語",
       "word " * 5000, "q" * 6000, "don't DON'T 'RE"]


def want(rows, capacity=2048):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((str(i), k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def check(df, rows, capacity=2048):
    found = df.collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
                  for r in found) == want(rows, capacity)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_odd_rows(docs_of):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "null id")]
    check(packing.pack(docs_of(rows), PATH), rows)


def test_whole_table_in_few_sequences(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    used = check(packing.pack(sample, PATH), rows)
    least = -(-sum(r[3] for r in want(rows)) // 2048)
    assert used <= 1.02 * least + 2
    check(packing.pack(sample, PATH, group_pieces=50), rows)


def test_empty_table(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0


def squares_rule(lengths, capacity):
    """The rule spelled out: try every open gap, count the squares anew."""
    gaps = []
    for size in sorted(lengths, reverse=True):
        def cost(gap):
            after = [*gaps]
            after.remove(gap)
            after += [gap - size] if gap > size else []
            return sum(after.count(g) ** 2 for g in set(after))
        open_gaps = sorted({g for g in gaps if g >= size})
        if open_gaps:
            best = min(open_gaps, key=lambda g: (cost(g), g))
            gaps.remove(best)
        else:
            best = capacity
        if best > size:
            gaps.append(best - size)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_places_follow_the_rule(seed):
    lengths = np.random.default_rng(seed).integers(1, 21, 60)
    sequence, offset = packing.place(lengths, 20)
    left = 20 - np.bincount(sequence, weights=lengths)
    assert sorted(int(g) for g in left if g) == squares_rule(lengths.tolist(), 20)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    monkeypatch.setattr(packing, "RUN_WORDS", 5)
    texts = [f"alpha beta{i} gamma{i % 3}, delta" for i in range(60)]
    ids = packing._Ids(PATH)
    t = Tokenizer.from_file(PATH)
    want_ids = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert ids.of(texts) == want_ids
    assert len(ids.chunks.new) + len(ids.chunks.old) < 60
