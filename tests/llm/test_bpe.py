import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from boostlab.llm import bpe
from boostlab.llm.queries import QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a", "<|endoftext|>", "x<|endoftext|> y <|endof", "  <|endoftext|>  z",
    "a  b\n\n c\t\r\n", "it's we'll 're  I'M don't'S 'll'''s", "日本語 текст  　  \x1c\x85 ½²",
    "😀" * 50, "é ñ ÿ", "\x0b\x0c \x1c\x1d\x1e\x1f ᠎​﻿ x", "\x00\x01 \x7f", "á ःो",
    "x y  z", "word " * 3000, "a" * 5000, " " * 5000, "\n" * 4100 + "x", "ab1 ,;" * 2500,
    "Zq" * 400 + "é" * 300,
]


def by_library(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((str(i), ids, t.decode(ids, skip_special_tokens=False)))
    return sorted(out)


def found(docs):
    read = bpe.decode(bpe.encode(docs, PATH), PATH)
    return sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in read.collect())


def test_odd_rows_like_the_library(docs_of):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "null id")]
    assert found(docs_of(rows)) == by_library(rows)


def test_random_texts_like_the_library(docs_of):
    draw = random.Random(5)
    letters = [*"abcdeABC 012 \n\t'.,-éßøĀſ²½ \x85 日😀\x1f", "<|endoftext|>", "'s", "  "]
    rows = [(i, "".join(draw.choice(letters) for _ in range(draw.randrange(80))))
            for i in range(600)]
    assert found(docs_of(rows)) == by_library(rows)


def test_whole_table_round_trip(spark, sf_dir, sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    want = [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(text.encode()).hexdigest()) for i, ids, text in by_library(rows)]
    got = QUERIES["op12_bpe"](spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == want


@pytest.mark.parametrize("short,together", [(0, 48), (3, 48), (10_000, 1), (10_000, 10**9)])
def test_scan_array_and_heap_agree(short, together, monkeypatch):
    """All words by the heap, by both, in arrays, one by one."""
    monkeypatch.setattr(bpe, "SHORT", short)
    monkeypatch.setattr(bpe, "TOGETHER", together)
    t, texts = Tokenizer.from_file(PATH), [text for text in ODD if text is not None]
    got = [list(memoryview(ids).cast("i")) for ids in bpe.Bpe(PATH).encode(texts)]
    assert got == [t.encode(text, add_special_tokens=False).ids for text in texts]


def test_every_pair_has_its_rank():
    own = bpe.Bpe(PATH)
    keys = np.fromiter(own.ranks, dtype=np.int64)
    assert own.pairs.get(keys).tolist() == list(own.ranks.values())
    others = np.setdiff1d(np.random.default_rng(1).integers(0, own.width**2, 200_000), keys)
    assert (own.pairs.get(others) == bpe._NONE).all()


def test_memory_is_bounded(monkeypatch):
    plain = bpe.Bpe(PATH)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 1)
    own = bpe.Bpe(PATH)
    texts = [f"alpha beta{i} gamma{i % 3}, delta <|endoftext|>" + "z" * 60 for i in range(60)]
    assert list(own.encode(texts)) == list(plain.encode(texts))
    assert len(own.new) + len(own.old) < 30
    assert max(map(len, own.new)) <= bpe.REMEMBERED_CHARS


def test_batches_of_bounded_size(docs_of, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_UNITS", 7)
    rows = [*enumerate(ODD[:12])]
    assert found(docs_of(rows)) == by_library(rows)


def test_decode_of_odd_lists(spark):
    rows = spark.createDataFrame(
        [(1, None), (2, []), (3, [64, None, 65]), (4, [50_256, 999_999]), (5, [162])],
        "doc_id long, ids array<int>")
    t = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: r["text"] for r in bpe.decode(rows, PATH).collect()}
    assert got == {1: "", 2: "", 3: t.decode([64, 65]), 4: "<|endoftext|>", 5: t.decode([162])}


def test_empty_table(docs_of):
    assert bpe.encode(docs_of([]), PATH).filter(F.size("ids") > 0).count() == 0
    assert found(docs_of([])) == []
