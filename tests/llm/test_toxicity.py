"""The field over whole sentences, however long."""

import numpy as np
import pytest
from boostlab.llm import toxicity


def field():
    rng = np.random.default_rng(5)
    return toxicity.Field(
        {b"bad": 5, b"odd": 2}, rng.normal(size=(3, toxicity.GRADES)), rng.normal(size=(2, 2)),
        -0.7, np.array([-2.0, 0.3, 2.0, -1.0]))


def long_sentences():
    rng = np.random.default_rng(6)
    return [bytes(rng.integers(0, toxicity.GRADES, n, dtype=np.uint8))
            for n in (1, 5, 64, 65, 130, 700, 3000)]


def whole(model, sentence):
    """Marginals, log partition and transitions of one row that holds the whole sentence."""
    x = np.frombuffer(sentence, dtype=np.uint8).astype(int)
    emit = model.emit[0][x] + model.emit[1][np.r_[0, x[:-1]]] + model.emit[2][np.r_[x[1:], 0]]
    total, toxic, moves = toxicity.forward_backward(
        emit[None], model.move, model.start, np.array([len(x)]))
    return toxic[0], total[0], moves[0]


def test_long_sentences_are_not_cut():
    model, sentences = field(), long_sentences()
    for sentence, got in zip(sentences, toxicity._marginals(model, sentences)):
        assert np.allclose(got, whole(model, sentence)[0])


def test_pieces_sum_up_to_their_sentences():
    model, sentences = field(), long_sentences()
    own = toxicity._pieces(sentences)
    total, _, moves = toxicity.forward_backward(
        model.emissions(own), model.move, model.start, own.sizes, own.first)
    begins = np.flatnonzero(own.first)
    assert np.allclose(total[begins], [whole(model, s)[1] for s in sentences])
    assert np.allclose(np.add.reduceat(moves, begins), [whole(model, s)[2] for s in sentences])


def test_a_long_toxic_run_is_one_span():
    model = field()
    model.emit[0, 5], model.move[:] = 9.0, 0.0
    text = "fine " * 50 + "bad " * 200 + "fine " * 50
    (_,), (spans,) = toxicity._score_batch(model, [text], [model.grades])
    assert [(s["first"], s["last"]) for s in spans] == [(250, 1049)]


@pytest.mark.parametrize("size", [3, 200])
def test_the_fit_settles(size):
    """The gradient vanishes at the weights found: no small step raises the likelihood."""
    rng = np.random.default_rng(7)
    counts = {}
    for n in rng.integers(1, size, 60):
        x = rng.integers(0, toxicity.GRADES, n, dtype=np.uint8)
        y = (x >= toxicity.STRONG) ^ (rng.random(n) < 0.1)
        counts[bytes(x), bytes(y.astype(np.uint8))] = 1.0 + n % 3
    state = toxicity._fit_field(counts)
    keys = sorted(counts)
    weight = np.array([counts[k] for k in keys]) / sum(counts.values())

    def likelihood(at):
        model = toxicity._unpacked(at)
        value = -toxicity.PENALTY / 2 * at @ at
        for (s, labels), w in zip(keys, weight):
            x, y = (np.frombuffer(k, dtype=np.uint8).astype(int) for k in (s, labels))
            emit = (model.emit[0][x] + model.emit[1][np.r_[0, x[:-1]]]
                    + model.emit[2][np.r_[x[1:], 0]])
            path = (emit * y).sum() + model.start * y[0] + model.move[y[:-1], y[1:]].sum()
            value += w * (path - whole(model, s)[1])
        return value

    slope = [(likelihood(state + 1e-4 * d) - likelihood(state - 1e-4 * d)) / 2e-4
             for d in np.eye(len(state))]
    assert np.abs(slope).max() < 1e-5


def test_rare_words_of_many_toxic_rows_are_known(spark):
    """A word of 10 toxic rows and no clean one counts, however many toxic rows there are."""
    texts = spark.createDataFrame(
        [("rareword", 1)] * 10 + [("common", 0)] * 10, "text string, toxic int")
    assert toxicity.lexicon(texts, 40_000, 400_000) == {b"rareword": 5}


def test_a_joined_lexicon_gives_the_same(spark, docs_of, monkeypatch):
    rows = [(i, f"nice text {i}. " + ("you stupid fool! " if i % 2 else "")) for i in range(80)]
    rows += [(100, None), (None, "stupid"), (None, "nice"), (1, "a nice stupid fool"), (1, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")

    def scored():
        model = toxicity.train(docs_of(rows), labels)
        got = toxicity.score(docs_of(rows), model).collect()
        return model, sorted(((r["doc_id"], round(r["score"], 6), r["predicted"], r["held_out"],
                               [(s["first"], s["last"]) for s in r["spans"]]) for r in got), key=str)

    model, want = scored()
    assert isinstance(model.grades, dict) and any(spans for *_, spans in want)
    monkeypatch.setattr(toxicity, "LEXICON_BYTES", 0)
    model, got = scored()
    assert not isinstance(model.grades, dict) and got == want
