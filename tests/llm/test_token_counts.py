import public_tokenizers
import pytest
from boostlab.llm import token_counts
from tokenizers import Tokenizer

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "a", "<|endoftext|>", "x<|endoftext|>y <|endof", "a  b\n\n c\t\r\n",
    "it's we'll 're  I'M", "日本語 текст  　 \x1c\x85 ½²", "😀" * 50, "é ñ ÿ",
    "word " * 3000, "a" * 5000, " " * 5000, "\n" * 4100 + "x", "ab1 ,;" * 2500,
]


def counts(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])
                  for r in df.collect())


def by_library(rows):
    t = Tokenizer.from_file(JSON)
    out = []
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((i, len((text or "").encode()), n, n > 512))
    return sorted(out)


@pytest.mark.parametrize("chunk,overlap", [(65_536, 2_048), (400, 60), (64, 20)])
def test_like_the_library(docs_of, chunk, overlap):
    rows = [*enumerate(ODD), (3, ODD[3]), (11, ODD[11])]
    found = token_counts.count_tokens(docs_of(rows), JSON, RANKS, chunk=chunk, overlap=overlap)
    assert counts(found) == by_library(rows)


def test_whole_table_in_small_chunks(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()]
    small = token_counts.count_tokens(sample, JSON, RANKS, chunk=500, overlap=100)
    assert counts(small) == by_library(rows)
    assert small.filter("chunked").count() > 10


def test_overlap_widens_until_boundaries_meet(docs_of):
    rows = [(1, "ab" * 2000), (2, "x " + "q" * 900 + " end of it " * 40)]
    found = token_counts.count_tokens(docs_of(rows), JSON, RANKS, chunk=200, overlap=40)
    assert counts(found) == by_library(rows)


def test_empty_table(docs_of):
    assert token_counts.count_tokens(docs_of([]), JSON, RANKS).count() == 0


def test_overlap_must_exceed_the_guard(docs_of):
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs_of([]), JSON, chunk=100, overlap=16)
