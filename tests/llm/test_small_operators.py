"""Odd rows, brute force and round trips of the operators that go document by document."""

import hashlib
import re

import numpy as np
import pytest
from boostlab.llm import chat, decontamination, exact_dedup, licenses, revisits, toxicity
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


# exact copies ---------------------------------------------------------------------------

def test_exact_copies(docs_of):
    rows = [(1, None), (2, ""), (3, "Ab"), (4, "aB"), (4, "aB"), (5, "É"), (6, "é"),
            (None, "ab"), (None, "alone"), (7, "long " * 50_000), (8, "LONG " * 50_000)]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"][:6])
           for r in exact_dedup.dedupe(docs_of(rows), capacity=1).collect()}

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()[:6]

    long = sha("long " * 50_000)
    assert got == {
        (1, 2, 2, False, sha("")), (2, 2, 2, True, sha("")), (3, 4, 4, False, sha("ab")),
        (4, 4, 4, True, sha("ab")), (None, 4, 4, False, sha("ab")), (5, 5, 1, True, sha("É")),
        (6, 6, 1, True, sha("é")), (None, None, 1, True, sha("alone")),
        (7, 8, 2, False, long), (8, 8, 2, True, long)}
    assert exact_dedup.dedupe(docs_of([])).count() == 0


def test_exact_copies_with_a_hot_text(docs_of):
    rows = [(i, "Hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    got = exact_dedup.dedupe(docs_of(rows)).collect()
    assert len(got) == 3000 and len({r["doc_id"] for r in got}) == 3000
    for r in got:
        hot = r["doc_id"] % 3 == 0
        assert (r["keep_id"], r["group_size"]) == ((2997, 1000) if hot else (r["doc_id"], 1))
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_index_splits_overfull_buckets(docs_of):
    index = exact_dedup.build_index(
        docs_of([(i, f"text {i}") for i in range(500)]), capacity=20).links
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 20
    spread = index.select("depth").distinct().count()
    assert spread > 1  # some buckets split further than others
    wrong = index.filter(F.expr(
        "bucket <> shiftleft(1L, depth) + if(depth = 0, 0, shiftrightunsigned(hash, 64 - depth))"))
    assert wrong.isEmpty()


def test_chains_hold_texts_of_one_hash(docs_of, monkeypatch):
    """With a hash that tells texts apart by their length alone, the chain decides."""
    rows = [(i, "x" * (i % 3) + str(i % 40)) for i in range(400)] + [(400, None), (401, "")]
    want = sorted(map(tuple, exact_dedup.dedupe(docs_of(rows)).collect()))
    monkeypatch.setattr(exact_dedup, "hashed", lambda norm: F.length(norm).cast("long"))
    index = exact_dedup.build_index(docs_of(rows))
    assert index.links.agg(F.max("chain")).first()[0] > 10
    assert sorted(map(tuple, exact_dedup.look_up(docs_of(rows), index).collect())) == want


def test_lookups_go_through_the_index(docs_of):
    """A spoiled slot, bucket or chain shows in the answers."""
    from dataclasses import replace

    docs = docs_of([(i, f"text {i % 250}") for i in range(500)])
    index = exact_dedup.build_index(docs, capacity=20)
    assert exact_dedup.look_up(docs, index).count() == 500
    one = index.links.orderBy("bucket", "hash").first()
    here = F.col("hash") == one["hash"]
    for spoiled in (
        replace(index, links=index.links.withColumn(
            "bucket", F.when(here, F.col("bucket") + 1).otherwise(F.col("bucket")))),
        replace(index, links=index.links.withColumn(
            "text_sha256", F.when(here, F.lit("?")).otherwise(F.col("text_sha256")))),
    ):
        assert exact_dedup.look_up(docs, spoiled).count() == 498
    none = replace(index, directory=index.directory.filter(F.col("bucket") != one["bucket"]))
    lost = index.links.filter(F.col("bucket") == one["bucket"]).count()
    assert exact_dedup.look_up(docs, none).count() == 500 - 2 * lost


def test_a_large_directory_is_joined(docs_of, monkeypatch):
    docs = docs_of([(i, f"text {i % 250}") for i in range(500)])
    want = sorted(map(tuple, exact_dedup.dedupe(docs, capacity=20).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_SLOTS", 0)
    assert sorted(map(tuple, exact_dedup.dedupe(docs, capacity=20).collect())) == want


# chat -----------------------------------------------------------------------------------

TURNS = [(1, 0, "system", "rules"), (1, 1, "user", None), (1, 2, "assistant", "a\\b <s> [INST]"),
         (1, 3, "assistant", "</s>[/INST]\\"), (2, 0, "user", "x"), (3, None, None, "\\<"),
         (3, 1, "assistant", "😀é"), (None, 0, "assistant", ""), (4, 0, "assistant", "[\\INST]"),
         (4, 0, "assistant", "[\\INST]"), (5, 0, "as</s>[/INST]sistant", "<" + "/s>" * 2000)]


@pytest.fixture(scope="module")
def formatted(spark):
    rows = spark.createDataFrame([(*r, 1) for r in TURNS],
                                 "conv_id long, turn long, role string, text string, start int")
    return chat.format_turns(rows)


def test_chat_round_trip(formatted):
    got = {r["conv_id"]: r for r in chat.read_back(formatted, chat.examples(formatted)).collect()}
    convs = {}
    for conv, turn, role, text in TURNS:
        convs.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (row["n_turns"], row["loss_chars"]) == (len(turns), len(loss))
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("column", ["loss_start", "loss_chars", "context_chars", "context_turns"])
def test_a_wrong_example_shows(formatted, column):
    """The digests come from the examples: one whose mask or context is off changes them."""
    made = chat.examples(formatted)
    wrong = made.withColumn(column, F.when(
        (F.col("conv_id") == 1) & (F.col("context_turns") == 2), F.col(column) + 1).otherwise(
        F.col(column)))
    if column == "context_turns":  # out of its place among the others
        wrong = made.withColumn(column, F.when(F.col("conv_id") == 1, -F.col(column)).otherwise(
            F.col(column)))
    right, other = ({r["conv_id"]: r["loss_sha256"] for r in chat.read_back(formatted, m).collect()}
                    for m in (made, wrong))
    assert right.keys() == other.keys() and [c for c in right if right[c] != other[c]] == [1]


def test_turns_are_read_from_contexts(formatted):
    """A context that is short by a turn loses that turn, and its example's reply comes twice;
    a conversation without its examples is still read whole."""
    def turns(made):
        return {r["conv_id"]: (r["n_turns"], r["turns_sha256"])
                for r in chat.read_back(formatted, made).collect()}

    made = chat.examples(formatted)
    right = turns(made)
    here = (F.col("conv_id") == 1) & (F.col("context_turns") == 2)
    short = turns(made.withColumn("context_turns", F.when(here, 1).otherwise(
        F.col("context_turns")).cast("long")))
    assert [c for c in right if right[c] != short[c]] == [1]
    want = "system\nrules\n" + 2 * "assistant\na\\b <s> [INST]\n" + "assistant\n</s>[/INST]\\\n"
    assert short[1] == (4, hashlib.sha256(want.encode()).hexdigest())
    other = turns(made.withColumn("reply", F.when(here, F.lit("<s>[INST]a[/INST]b</s>")).otherwise(
        F.col("reply"))))
    assert [c for c in right if right[c] != other[c]] == [1]
    assert turns(made.filter("conv_id <> 1")) == right


def test_no_conversations(spark, formatted):
    none = chat.format_turns(spark.createDataFrame(
        [], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(none, chat.examples(none)).count() == chat.written_out(none).count() == 0


def test_chat_examples_are_prefixes(formatted):
    whole = {(r["conv_id"], r["context_turns"]): r for r in chat.written_out(formatted).collect()}
    short = chat.examples(formatted).collect()
    assert len(short) == len(whole) == sum(r == "assistant" for _, _, r, _ in TURNS)
    for e in short:
        text = whole[e["conv_id"], e["context_turns"]]["example"]
        assert len(text) == e["example_chars"] and text[e["context_chars"]:] == e["reply"]
        reply = text[e["loss_start"]:e["loss_start"] + e["loss_chars"]]
        assert not any(mark in reply for mark in chat.CONTROLS)
        assert text[e["loss_start"] + e["loss_chars"]:] == "</s>"


# decontamination ------------------------------------------------------------------------

def brute_hits(docs, items, n):
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            g = words(body)
            size = min(n, len(g))
            grams = {tuple(g[a:a + size]) for a in range(len(g) - size + 1)} if size else set()
            for a in range(len(w) - size + 1 if size else 0):
                if tuple(w[a:a + size]) in grams:
                    hit.update(range(a, a + size))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [decontamination.BROADCAST_CHARS, 0])
def test_decontamination(spark, docs_of, chars):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short one!"),
             (10, "short one"), (3, None), (4, "..."), (None, "null id item"), (5, "a a a")]
    docs = [(1, "x ONE two three four five six seven eight nine ten; y eleven"), (2, None),
            (3, ""), (4, "short, one short-one"), (5, "a a a a b"), (6, "null id item " * 2000),
            (7, "two three four five six seven eight nine ten"), (8, "Été one"),
            (4, "short, one short-one"), (7, "short one again"), (None, "a short one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find(docs_of(docs), benchmark, broadcast_chars=chars)
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits(docs, items, 10)
    none = decontamination.find(docs_of(docs), benchmark.limit(0), broadcast_chars=chars - 1)
    assert not none.filter("contaminated").count() and none.count() == len(docs)
    assert decontamination.find(docs_of([]), benchmark, broadcast_chars=chars).count() == 0


@pytest.mark.parametrize("chars", [decontamination.BROADCAST_CHARS, 0])
def test_spans_are_cut(spark, docs_of, chars):
    benchmark = spark.createDataFrame(
        [(1, "secret passage"), (2, "x"), (3, None)], "item_id long, text string")
    rows = [(1, "Été, a Secret -- PASSAGE, end."), (2, None), (3, "clean text"), (1, "x y x"),
            (None, "secret passage secret"), (4, ""), (5, "a X. " * 3000)]
    docs = docs_of(rows)
    got = decontamination.remove_spans(docs, benchmark, broadcast_chars=chars)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([
        (1, "Été, a , end."), (2, None), (3, "clean text"), (1, " y "), (None, " secret"),
        (4, ""), (5, "a . " * 3000)], key=str)
    none = decontamination.remove_spans(docs, benchmark.limit(0), broadcast_chars=chars - 1)
    assert sorted(none.collect(), key=str) == sorted(docs.collect(), key=str)
    assert decontamination.remove_spans(docs_of([]), benchmark, broadcast_chars=chars).count() == 0


def test_cut_spans_of_the_table(spark, sf_dir, sample):
    """Both ways cut the same words, and what is left has no hit at a cut any more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one, other = ({r["doc_id"]: r["text"] for r in decontamination.remove_spans(
        sample, benchmark, broadcast_chars=chars).collect()} for chars in (10**7, 0))
    assert one == other
    hit = {r["doc_id"] for r in decontamination.find(sample, benchmark).collect()
           if r["contaminated"]}
    before = {r["doc_id"]: r["text"] for r in sample.collect()}
    assert {i for i in before if before[i] != one[i]} == hit and hit


# licenses -------------------------------------------------------------------------------

def test_base_phrases_on_the_table(sample):
    got = {r["doc_id"]: r for r in licenses.scan(sample).collect()}
    seen = 0
    for row in sample.collect():
        w = words(row["text"])
        places = [(a, label) for phrase, label in licenses.PHRASES.items()
                  for a in range(len(w)) if w[a:a + len(phrase.split())] == phrase.encode().split()]
        r = got[row["doc_id"]]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert r["first_word"] == min((a for a, _ in places), default=None)
        assert r["last_word"] == max((a for a, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        seen += bool(places)
    assert seen


def test_markup():
    auto = licenses.TokenAutomaton({
        "a <<opt>>b <<opt>>c<</opt>><</opt>> d": "opt", "s <<var max=2>> t": "var"})

    def run(text):
        return auto.run(text.encode().split())

    assert run("a d") == [(0, 2, "opt")] and run("a b d") == [(0, 3, "opt")]
    assert run("a b c d") == [(0, 4, "opt")] and run("a c d") == []
    assert run("s t") == [(0, 2, "var")] and run("x s p q t") == [(1, 5, "var")]
    assert run("s p q r t") == [] and run("s t t t") == [(0, 4, "var")]


def test_licenses_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "MIT License / mit-license"), (3, "MIT License / mit-license"),
            (4, "permission is hereby granted " * 2000), (None, "cc by"),
            (5, "Licensed under the Apache License, Version 2.0.")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["labels"], r["score"])
                  for r in licenses.scan(docs_of(rows)).collect()), key=str)
    assert got == sorted([
        (1, 0, 0, "", 0.0), (2, 0, 0, "", 0.0), (3, 4, 2, "mit", 1.0), (3, 4, 2, "mit", 1.0),
        (4, 8000, 0, "", 0.0), (None, 2, 1, "cc-by", 1.0),
        (5, 8, 1, "apache,apache-2.0-notice,apache-notice", 1.0)], key=str)
    assert licenses.scan(docs_of([])).count() == 0


# revisits -------------------------------------------------------------------------------

def test_revisits(spark):
    def at(m):
        return f"2024-01-0{1 + m // 24} {m % 24:02d}:00:00"

    rows = [
        (1, "response", "http://www.A.com:80/x/?b=1&utm_x=2&a=3#f", at(1),
         {"ETag": '"1"', "Vary": "old", "Content-Type": "t"}, "d1", "one"),
        (2, "response", "https://a.com/x?a=3&b=1", at(30), {"etag": '"2"'}, "d2", "two"),
        (2, "response", "https://a.com/x?a=3&b=1", at(30), {"etag": '"2"'}, "d2", "two"),
        (3, "revisit", "a.com/x?a=3&b=1", at(5), {"ETAG": 'W/"1"', "vary": "new", "Content-Type": "u"},
         None, None),
        (4, "revisit", "a.com/x?a=3&b=1", at(30), None, "d1", None),
        (5, "revisit", "a.com/x?a=3&b=1", at(80), {"etag": '"1"'}, "d2", None),
        (6, "revisit", "a.com/x?a=3&b=1", at(81), {}, None, None),
        (7, "revisit", "b.com", at(81), {}, None, None), (8, "revisit", None, at(81), {}, None, None),
        (9, "revisit", "a.com/x?a=3&b=1", None, {}, None, None),
        (10, "revisit", "a.com/x?a=3&b=1", at(0), {}, None, None)]
    records = spark.createDataFrame(
        rows, "record_id long, kind string, url string, date string, headers map<string,string>, "
        "digest string, body string").withColumn("date", F.to_timestamp("date")).withColumn(
        "state", F.lit(1))
    got = {r["record_id"]: r for r in revisits.resolve(records).collect()}
    assert {k: (r["response_id"], r["state"], r["body"]) for k, r in got.items()} == {
        3: (1, "resolved", "one"), 4: (1, "resolved", "one"), 5: (2, "mismatch", None),
        6: (2, "unverified", None), 7: (None, "missing", None), 8: (None, "missing", None),
        9: (None, "missing", None), 10: (None, "missing", None)}
    assert got[3]["headers"] == {"etag": 'W/"1"', "vary": "new", "content-type": "t"}
    assert revisits.resolve(records.limit(0)).count() == 0


# toxicity -------------------------------------------------------------------------------

def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    emit, move, start = rng.normal(size=(2, 5)), rng.normal(size=(2, 2)), 0.3
    sizes = np.array([5, 3])
    total, toxic, moves = toxicity.forward_backward(emit, move, start, sizes)
    for s, n in enumerate(sizes):
        weight, marginal, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2 ** n):
            y = [code >> t & 1 for t in range(n)]
            score = start * y[0] + sum(emit[s, t] * y[t] for t in range(n)) + sum(
                move[a, b] for a, b in zip(y, y[1:]))
            weight += np.exp(score)
            marginal += np.exp(score) * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += np.exp(score)
        assert np.isclose(total[s], np.log(weight))
        assert np.allclose(toxic[s, :n], marginal / weight) and not toxic[s, n:].any()
        assert np.allclose(moves[s], pairs / weight)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    held = scored.filter("held_out").select("predicted", "toxic").toPandas()
    assert (held["predicted"] == held["toxic"]).mean() > 0.97
    assert held[held["predicted"] == 1]["toxic"].mean() > 0.95
    some = scored.filter("size(spans) > 0").join(docs, "doc_id").select("text", "spans").first()
    first = some["spans"][0]
    assert some["text"][first["first"]:first["last"]].strip().isalpha()


def test_toxicity_odd_rows(spark, docs_of):
    rows = [(i, f"nice text {i}. " + ("you stupid fool! " if i % 2 else "")) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "stupid " * 20_000), (None, "stupid"), (1, rows[1][1])]
    docs = docs_of(rows)
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(80)] + [(1, 0), (None, 1), (5, None)],
        "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    wrong = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 80
             and r["predicted"] != r["doc_id"] % 2]
    assert not wrong
    clean = toxicity.train(docs, labels.filter("toxic = 0"))
    assert clean == 0.0 and toxicity.score(docs, clean).filter("predicted = 1").isEmpty()
    assert toxicity.train(docs, labels.limit(0)) == 0.0
    assert toxicity.score(docs_of([]), 0.0).count() == 0


# pipeline -------------------------------------------------------------------------------

def test_stages_keep_what_they_should(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).cache()
        assert kept.columns == columns and kept.exceptAll(docs).isEmpty()
        assert n * 0.7 < kept.count() <= n, name
        docs, n = kept, kept.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == n
