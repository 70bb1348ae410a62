"""Toxic spans and document scores by a linear-chain conditional random field.

1. Corpus statistics. Over all labelled training rows Spark counts, per word, the toxic and
   the clean documents that hold it. Words whose log-odds are clearly above zero form the
   lexicon (at every size the same test; a large lexicon is joined instead of broadcast), each with a grade from 1 (weak) to ``GRADES - 1``; any other word has grade 0.
2. Labelled tokens. A token of a toxic document is labelled toxic if its grade is strong,
   all other tokens are labelled clean. The field is fitted, until the likelihood settles, to the
   sentences of a bounded sample: at most ``sample`` toxic and twice as many clean rows,
   those with the smallest hashes of their ids.
3. Scoring. Forward-backward gives every token of a whole text its marginal probability. A
   document's score is a logistic function, fitted to the same sample, of its largest
   marginal, its expected number of toxic tokens and its words. Tokens with a marginal of
   one half or more make up the offending spans.

Sentences end at ``. ! ?`` or a line break and may have any length: longer ones are worked
through in pieces of ``PIECE`` words that hand on their sums, with the results of the whole.
A sentence without lexicon words has the same small marginals everywhere and adds nothing.

Defined results: a null text is empty and scored like any other; ids and labels serve
training alone; null labels are left out; with several labels of one id the largest holds;
without toxic or without clean training rows every score is the share of toxic rows (0 if
there are none); a repeated row repeats its result; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlab.llm.common import empty_if_null, lowered, lowered_bytes, numbered, settled

FOLDS = 5
#: Most labels (an id and a class, some 16 bytes) that are broadcast.
BROADCAST_LABELS = 500_000
#: Most toxic training rows whose texts the field is fitted to; twice as many clean ones.
SAMPLE = 1_000
#: Fewest toxic training rows that hold a word of the lexicon, whatever their number, and the
#: log-odds it needs as a multiple of their standard error.
LEAST_DOCS, LEAST_Z = 4, 3
#: Largest lexicon (its words, and 100 bytes for each) that is broadcast; a larger one is
#: joined with the words of the rows.
LEXICON_BYTES = 16_000_000
#: Log-odds at which the grades 1, 2, ... begin; a strong token labels a toxic span.
GRADE_EDGES = (1.0, 2.0, 3.0, 4.0, 5.0)
GRADES, STRONG = len(GRADE_EDGES) + 1, 4
#: Words of a sentence that are worked through in one row, and rows at a time.
PIECE, BLOCK = 64, 512
#: Weight of the squared weights, and the largest slope at which the field counts as fitted.
PENALTY, SETTLED = 1e-4, 1e-6
_TOKEN = re.compile(rb"[^\x00-\x60\x7b-\x7f]+|[.!?\n]")
_ENDS = (b".", b"!", b"?", b"\n")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, by ``FOLDS``; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@dataclass
class Field:
    """Weights: of the grades of a token and its neighbours (for the label toxic), of the
    four transitions, of a toxic start; and the document score's coefficients."""

    grades: dict[bytes, int] | DataFrame | None
    emit: np.ndarray
    move: np.ndarray
    start: float
    score: np.ndarray

    def emissions(self, own: Pieces) -> np.ndarray:
        return self.emit[0][own.x] + self.emit[1][own.before] + self.emit[2][own.after]


def forward_backward(emit: np.ndarray, move: np.ndarray, start: float, sizes: np.ndarray,
                     first: np.ndarray | None = None):
    """Of padded rows: log partition of the sentence, marginals of the label toxic, and the
    expected transitions into the row's words (2 x 2).

    A row is a sentence or, with ``first`` given, a piece of one: a sentence begins where
    ``first`` is set and its pieces follow. Pieces hand their sums over both labels to the
    pieces before and after them, so the results are those of whole sentences.
    """
    n, longest = emit.shape
    order = np.argsort(-sizes, kind="stable")
    live = [int((sizes > t).sum()) for t in range(longest)] + [0]
    emit = np.ascontiguousarray(emit[order].T)
    entry, leave, came = np.zeros((2, n)), np.zeros((2, n)), np.zeros((2, n))
    entry[1] = start
    joined = np.zeros(n, dtype=bool)
    if first is not None and not first.all():
        entry, leave, came = _handed(emit, move, start, sizes, first, order, live)
        joined = ~first[order]
    entry, leave, came = entry[:, order], leave[:, order], came[:, order]
    fore = np.zeros((2, longest, n))
    back = np.zeros((2, longest, n))
    for y in (0, 1):
        fore[y, 0] = entry[y] + (emit[0] if y else 0.0)
    for t in range(1, longest):
        k = live[t]
        for y in (0, 1):
            fore[y, t, :k] = np.logaddexp(
                fore[0, t - 1, :k] + move[0, y], fore[1, t - 1, :k] + move[1, y]
            ) + (emit[t, :k] if y else 0.0)
    for t in range(longest - 1, -1, -1):
        k, upto = live[t + 1], live[t]
        back[:, t, k:upto] = leave[:, k:upto]
        if k:
            for y in (0, 1):
                back[y, t, :k] = np.logaddexp(
                    move[y, 0] + back[0, t + 1, :k],
                    move[y, 1] + emit[t + 1, :k] + back[1, t + 1, :k])
    last, rows = sizes[order] - 1, np.arange(n)
    total = np.logaddexp(fore[0, last, rows] + back[0, last, rows],
                         fore[1, last, rows] + back[1, last, rows])
    within = np.arange(longest)[:, None] <= last
    toxic = np.where(within, np.exp(np.minimum(fore[1] + back[1] - total, 0)), 0.0)
    moves = np.zeros((n, 2, 2))
    for a in (0, 1):
        for b in (0, 1):
            joint = fore[a, :-1] + move[a, b] + back[b, 1:] + (
                emit[1:] if b else 0.0) - total
            moves[:, a, b] = np.where(within[1:], np.exp(np.minimum(joint, 0)), 0.0).sum(0)
            joint = came[a] + move[a, b] + back[b, 0] + (emit[0] if b else 0.0) - total
            moves[:, a, b] += np.where(joined, np.exp(np.minimum(joint, 0)), 0.0)
    at = np.argsort(order, kind="stable")
    return total[at], toxic[:, at].T, moves[at]


def _handed(emit: np.ndarray, move: np.ndarray, start: float, sizes: np.ndarray,
            first: np.ndarray, order: np.ndarray, live: list[int]):
    """Of pieces: log sums per label of all ways to reach the first word (without its
    emission), of all ways to go on after the last word, and of all ways to reach the last
    word of the piece before."""
    n = len(sizes)
    through = np.zeros((2, 2, n))
    whole = first[order]
    for a in (0, 1):
        f0 = np.where(whole, 0.0, move[a, 0])
        f1 = np.where(whole, start, move[a, 1]) + emit[0]
        for t in range(1, len(emit)):
            k = live[t]
            g0 = np.logaddexp(f0[:k] + move[0, 0], f1[:k] + move[1, 0])
            f1[:k] = np.logaddexp(f0[:k] + move[0, 1], f1[:k] + move[1, 1]) + emit[t, :k]
            f0[:k] = g0
        through[a, 0, order], through[a, 1, order] = f0, f1
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.arange(n) - begin
    by_rank = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
    rounds = [by_rank[bounds[r]:bounds[r + 1]] for r in range(1, rank.max() + 1)]
    reach, leave = through[0].copy(), np.zeros((2, n))
    for rows in rounds:
        reach[:, rows] = np.logaddexp(reach[0, rows - 1] + through[0][:, rows],
                                      reach[1, rows - 1] + through[1][:, rows])
    for rows in reversed(rounds):
        leave[:, rows - 1] = np.logaddexp(through[:, 0, rows] + leave[0, rows],
                                          through[:, 1, rows] + leave[1, rows])
    came = np.roll(reach, 1, axis=1)
    entry = np.logaddexp(came[0] + move[0][:, None], came[1] + move[1][:, None])
    entry[:, first] = np.array([[0.0], [start]])
    return entry, leave, came


@dataclass
class Pieces:
    """Sentences in pieces of at most ``PIECE`` words, padded: grades of every word and of the
    words before and after it in its sentence."""

    x: np.ndarray
    before: np.ndarray
    after: np.ndarray
    sizes: np.ndarray
    first: np.ndarray


def _padded(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    x = np.zeros((len(parts), sizes.max()), dtype=np.int64)
    x[np.arange(x.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return x


def _cut(sentences: list[bytes]) -> list[bytes]:
    return [s[i:i + PIECE] for s in sentences for i in range(0, len(s), PIECE)]


def _pieces(sentences: list[bytes]) -> Pieces:
    parts = _cut(sentences)
    sizes = np.array([len(p) for p in parts])
    first = np.array([i == 0 for s in sentences for i in range(0, len(s), PIECE)])
    return Pieces(
        _padded(parts, sizes),
        _padded(_cut([b"\x00" + s[:-1] for s in sentences]), sizes),
        _padded(_cut([s[1:] + b"\x00" for s in sentences]), sizes), sizes, first)


def _fit_field(counts: dict[tuple[bytes, bytes], float]) -> np.ndarray:
    """Quasi-Newton ascent (BFGS) on the penalised likelihood of weighted sentences, each
    given as its grades and its labels, until the gradient is below ``SETTLED`` or no step
    raises the likelihood any more. It has one maximum."""
    keys = sorted(counts)
    own = _pieces([k[0] for k in keys])
    y = _padded(_cut([k[1] for k in keys]), own.sizes)
    y_before = _padded(_cut([b"\x00" + k[1][:-1] for k in keys]), own.sizes)
    weight = np.array([counts[k] for k in keys])
    weight = np.repeat(weight / weight.sum(), [-(-len(k[0]) // PIECE) for k in keys])
    within = (np.arange(y.shape[1]) < own.sizes[:, None]) * weight[:, None]
    pair = within.copy()
    pair[own.first, 0] = 0.0

    def features(of: np.ndarray, moves: np.ndarray) -> np.ndarray:
        return np.concatenate([
            np.bincount(own.x.ravel(), of.ravel(), GRADES),
            np.bincount(own.before.ravel(), of.ravel(), GRADES),
            np.bincount(own.after.ravel(), of.ravel(), GRADES),
            moves.ravel(), [of[own.first, 0].sum()]])

    seen = features(y * within, np.array(
        [[(pair * ((y_before == a) & (y == b))).sum() for b in (0, 1)] for a in (0, 1)]))

    def likelihood(state: np.ndarray) -> tuple[float, np.ndarray]:
        model = _unpacked(state)
        total, toxic, moves = forward_backward(
            model.emissions(own), model.move, model.start, own.sizes, own.first)
        made = features(toxic * within, np.einsum("n,nab->ab", weight, moves))
        value = state @ seen - (weight * total)[own.first].sum() - PENALTY / 2 * state @ state
        return value, seen - made - PENALTY * state

    state, bend = np.zeros(3 * GRADES + 5), np.eye(3 * GRADES + 5)
    value, rise = likelihood(state)
    while np.abs(rise).max() > SETTLED:
        way, size = bend @ rise, 1.0
        while True:
            step = size * way
            new_value, new_rise = likelihood(state + step)
            if new_value >= value + 1e-4 * (rise @ step) and new_value > value:
                break
            size /= 2
            if np.abs(size * way).max() < 1e-9:
                return state
        gap = rise - new_rise
        curve = gap @ step
        if curve > 1e-14:
            part = np.eye(len(state)) - np.outer(step, gap) / curve
            bend = part @ bend @ part.T + np.outer(step, step) / curve
        state, value, rise = state + step, new_value, new_rise
    return state


def _unpacked(state: np.ndarray, grades: dict[bytes, int] | DataFrame | None = None) -> Field:
    return Field(grades, state[:3 * GRADES].reshape(3, GRADES),
                 state[-5:-1].reshape(2, 2), float(state[-1]), np.zeros(4))


def _sentences(body: bytes, grades: dict[bytes, int]) -> tuple[list[bytes], int]:
    """Grades of the words of every sentence, and the number of words."""
    get = grades.get
    marks = bytes([255 if t in _ENDS else get(t, 0) for t in _TOKEN.findall(body)])
    parts = [s for s in marks.split(b"\xff") if s]
    return parts, sum(map(len, parts))


def _marginals(field_: Field, sentences: list[bytes]) -> list[np.ndarray]:
    """Marginals per sentence; equal sentences are worked out once."""
    distinct = sorted(set(sentences), key=len)
    ends = np.cumsum([-(-len(s) // PIECE) for s in distinct])
    known: dict[bytes, np.ndarray] = {}
    at = 0
    while at < len(distinct):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right"))
        block = distinct[at:max(upto, at + 1)]
        own = _pieces(block)
        _, toxic, _ = forward_backward(
            field_.emissions(own), field_.move, field_.start, own.sizes, own.first)
        flat = toxic[np.arange(toxic.shape[1]) < own.sizes[:, None]]
        known.update(zip(block, np.split(flat, np.cumsum([len(s) for s in block])[:-1])))
        at += len(block)
    return [known[s] for s in sentences]


def _fit_score(inputs: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, until the gradient is gone. The penalty
    makes the optimum one point, and a bounded step keeps the way there."""
    w = np.zeros(inputs.shape[1])
    penalty = 1e-3 * np.eye(len(w))
    settled_at = 1e-9 * max(1.0, float(np.abs(weight).sum()))
    while True:
        p = 1 / (1 + np.exp(-np.clip(inputs @ w, -30, 30)))
        slope = inputs.T @ (weight * (y - p)) - penalty @ w
        if np.abs(slope).max() <= settled_at:
            return w
        bend = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + penalty
        w = w + np.clip(np.linalg.solve(bend, slope), -5, 5)


def _words(text: str) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(
        lowered(F.col(text)), F.lit(r"[^\x00-\x60\x7b-\x7f]+"), F.lit(0)))


def lexicon(texts: DataFrame, n_toxic: int, n_clean: int) -> dict[bytes, int] | DataFrame:
    """Grades of the words that speak for toxic texts; rows are (text, toxic). Beyond
    ``LEXICON_BYTES`` they stay a table (word, grade)."""
    words = texts.select("toxic", F.explode(_words("text")).alias("word"))
    held = words.groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = held.filter(F.col("a") >= LEAST_DOCS).withColumn(
        "lo",
        F.log((F.col("a") + 0.5) / (F.lit(n_toxic) - F.col("a") + 0.5))
        - F.log((F.col("b") + 0.5) / (F.lit(n_clean) - F.col("b") + 0.5)),
    ).withColumn("z", F.col("lo") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))
    grade = sum((F.col("lo") >= edge).cast("int") for edge in GRADE_EDGES)
    chosen = settled(odds.filter((F.col("lo") >= GRADE_EDGES[0]) & (F.col("z") >= LEAST_Z))
                     .select("word", grade.alias("grade")))
    size = chosen.agg(F.sum(F.octet_length("word") + 100)).first()[0] or 0
    if size > LEXICON_BYTES:
        return chosen
    return {r["word"].encode(): r["grade"] for r in chosen.collect()}


def _with_grades(rows: DataFrame, grades: dict[bytes, int] | DataFrame) -> DataFrame:
    """The rows and, if the lexicon is a table, what each needs of it (``words``, ``grades``)."""
    if isinstance(grades, dict):
        return rows
    rows = numbered(rows)
    held = rows.select("row", F.explode(_words("text")).alias("word")).join(
        grades, "word").groupBy("row").agg(
        F.collect_list(F.struct("word", "grade")).alias("held")).select(
        F.col("row").alias("__of"), F.col("held.word").alias("words"),
        F.col("held.grade").alias("grades"))
    return rows.join(held, rows["row"] == held["__of"], "left").drop("row", "__of")


def _grades_of(frame: pd.DataFrame, shared: dict[bytes, int] | None) -> list[dict[bytes, int]]:
    """The lexicon of every row: the shared one, or what was joined."""
    if shared is not None:
        return [shared] * len(frame)
    return [{} if words is None else {w.encode(): int(g) for w, g in zip(words, grades)}
            for words, grades in zip(frame["words"], frame["grades"])]


def _labelled(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The labelled rows; texts are shuffled, and then written once, only if the labels are
    too many to be sent to all tasks."""
    if marked.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(marked), "doc_id")
    return settled(rows.join(marked, "doc_id"))


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text",
    doc_id: str = "doc_id", label: str = "toxic",
) -> Field | float:
    """A field fitted to the training rows, or one score for all if a class is missing."""
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), empty_if_null(F.col(text)).alias("text"))
    training = _labelled(rows, marked.filter(fold(F.col("doc_id")) != 0))
    sizes = dict(training.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
    grades = lexicon(training, n_toxic, n_clean)
    shared = grades if isinstance(grades, dict) else None

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [_sentences(lowered_bytes(t), own)
                    for t, own in zip(frame["text"], _grades_of(frame, shared))]
            yield pd.DataFrame({
                "toxic": frame["toxic"], "n_words": [n for _, n in made],
                "sentences": [s for s, _ in made]})

    ids = training.select("doc_id", "toxic").distinct()
    chosen = [
        ids.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample * (2 - kind)) for kind in (0, 1)
    ]
    picked = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    drawn = _with_grades(picked, grades).mapInPandas(
        shrink, "toxic int, n_words long, sentences array<binary>").collect()
    counts: dict[tuple[bytes, bytes], float] = {}
    for row in drawn:
        for grade in map(bytes, row["sentences"]):
            own = bytes(int(row["toxic"] and g >= STRONG) for g in grade)
            counts[grade, own] = counts.get((grade, own), 0.0) + 1.0
    if not counts:
        return n_toxic / (n_toxic + n_clean)
    made = _unpacked(_fit_field(counts), grades)
    inputs = np.zeros((len(drawn), 4))
    for i, row in enumerate(drawn):
        live = [s for s in map(bytes, row["sentences"]) if s.strip(b"\x00")]
        inputs[i] = _inputs(_marginals(made, live) if live else [], row["n_words"])
    y = np.array([row["toxic"] for row in drawn], dtype=float)
    share = np.where(y == 1, n_toxic / max(1, y.sum()), n_clean / max(1, (1 - y).sum()))
    made.score = _fit_score(inputs, y, share / share.mean())
    return made


def _inputs(live: list[np.ndarray], n_words: int) -> tuple:
    """The inputs of the document score."""
    top = min(max(max((float(m.max()) for m in live), default=0.0), 1e-4), 1 - 1e-4)
    return (1.0, np.log(top / (1 - top)), np.log1p(sum(float(m.sum()) for m in live)),
            np.log1p(n_words) / 10)


def score(
    docs: DataFrame, model: Field | float, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, spans (of characters, with their
    largest marginal)."""
    grades = {} if isinstance(model, float) else model.grades
    if not isinstance(grades, dict):
        model = replace(model, grades=None)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at:at + 512]
                if isinstance(own, float):
                    scores, spans = [own] * len(part), [[] for _ in range(len(part))]
                else:
                    scores, spans = _score_batch(
                        own, list(part["text"]), _grades_of(part, own.grades))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                    "held_out": part["held_out"].to_numpy(), "score": scores,
                    "predicted": [int(s >= 0.5) for s in scores], "spans": spans,
                }).astype({"doc_id": "Int64"})

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(fold(F.col(doc_id)) == 0, F.lit(False)).alias("held_out"),
        empty_if_null(F.col(text)).alias("text"))
    return _with_grades(rows, grades).mapInPandas(
        run, "doc_id long, held_out boolean, score double, predicted int, "
        "spans array<struct<first: long, last: long, p: double>>")


def _score_batch(model: Field, texts: list[str], grades: list[dict[bytes, int]]):
    split = [_sentences(lowered_bytes(t), own) for t, own in zip(texts, grades)]
    live = [s for sentences, _ in split for s in sentences if s.strip(b"\x00")]
    found = iter(_marginals(model, live) if live else [])
    scores, spans = [], []
    for body, (sentences, n_words) in zip(texts, split):
        own = [next(found) if s.strip(b"\x00") else None for s in sentences]
        some = [m for m in own if m is not None]
        x = np.array(_inputs(some, n_words))
        scores.append(float(1 / (1 + np.exp(-np.clip(x @ model.score, -30, 30)))))
        hit = any((m >= 0.5).any() for m in some)
        spans.append(_spans(body, sentences, own) if hit else [])
    return scores, spans


def _spans(body: str, sentences: list[bytes], marginals: list) -> list[dict]:
    """Runs of offending words, as places of characters."""
    p = np.concatenate([np.zeros(len(s)) if m is None else m
                        for s, m in zip(sentences, marginals)])
    ids = np.concatenate([np.full(len(s), i) for i, s in enumerate(sentences)])
    raw = lowered_bytes(body)
    places = [m.span() for m in _TOKEN.finditer(raw) if m.group() not in _ENDS]
    out: list[dict] = []
    before = (-2, -1)
    chars, upto = 0, 0
    for i in np.flatnonzero(p >= 0.5).tolist():
        first, last = places[i]
        chars += len(raw[upto:first].decode("utf-8", "replace"))
        size = len(raw[first:last].decode("utf-8", "replace"))
        if before == (i - 1, ids[i]):
            out[-1]["last"] = chars + size
            out[-1]["p"] = max(out[-1]["p"], float(p[i]))
        else:
            out.append({"first": chars, "last": chars + size, "p": float(p[i])})
        chars, upto, before = chars + size, last, (i, ids[i])
    return out
