"""Null and repeated ids: every stage decides row by row."""

from collections import Counter

import corpus_pipeline
import pytest


def long_text(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


PASSAGE = "the quick passage of this benchmark has just over ten words in it"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    spark.createDataFrame(
        [(i, i % 2) for i in range(80)], "doc_id long, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path


def stay(spark, docs_of, folder, stage, rows):
    left = dict(corpus_pipeline.STAGES[:-1])[stage](spark, docs_of(rows), folder)
    assert left.columns == docs_of(rows).columns
    return Counter((r["doc_id"], r["text"]) for r in left.collect())


def test_toxic_rows_go_whatever_their_ids(spark, docs_of, folder):
    rows = [(i, f"nice text {i}. " + ("you stupid fool! " if i % 2 else "")) for i in range(80)]
    bad, good = "you stupid fool! you stupid fool!", "a nice text"
    odd = [(None, good), (None, bad), (None, bad), (200, good), (200, bad), (201, good), (201, good)]
    left = stay(spark, docs_of, folder, "toxicity", rows + odd)
    assert left == Counter(r for r in rows + odd if "stupid" not in r[1])


def test_one_row_of_equal_texts_stays(spark, docs_of, folder):
    rows = [(5, "one text"), (5, "one text"), (None, "One text"), (4, "one text"),
            (None, "two"), (None, "two"), (6, "three"), (6, "four"), (7, "four"), (7, "FOUR")]
    left = stay(spark, docs_of, folder, "exact_dedup", rows)
    assert Counter(t.lower() for _, t in left.elements()) == Counter(
        ["one text", "two", "three", "four"])
    assert {(5, "one text"), (None, "two"), (6, "three")} <= set(left)
    assert [i for i, t in left if t.lower() == "four"] == [7]


def test_one_row_of_near_copies_stays(spark, docs_of, folder):
    a, b, c = long_text("a"), long_text("b"), long_text("c")
    rows = [(None, a), (None, a + " end"), (9, b + " end"), (None, b), (8, b), (8, b),
            (8, c), (3, c + " end"), (None, ""), (None, None)]
    left = stay(spark, docs_of, folder, "near_dedup", rows)
    ends = [(i, (t or "").split()[:1]) for i, t in left.elements()]
    assert sorted(ends, key=str) == sorted(
        [(None, ["a0"]), (8, ["b0"]), (3, ["c0"]), (None, []), (None, [])], key=str)


def test_contaminated_rows_go_whatever_their_ids(spark, docs_of, folder):
    rows = [(None, "clean"), (None, f"so {PASSAGE}"), (3, "clean"), (3, PASSAGE), (3, "clean"),
            (4, PASSAGE), (4, PASSAGE)]
    left = stay(spark, docs_of, folder, "decontamination", rows)
    assert left == Counter([(None, "clean"), (3, "clean"), (3, "clean")])


def test_packing_takes_every_row(spark, docs_of, folder):
    rows = [(None, "a b"), (None, "a b"), (3, "c"), (3, "d e f")]
    packed = corpus_pipeline.pack(spark, docs_of(rows), folder).collect()
    assert Counter(r["doc_id"] for r in packed) == Counter({None: 2, 3: 2})
