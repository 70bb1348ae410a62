"""Periodic runs of words by maximal pairs in the LCP-interval tree of each text.

A run is a stretch of words with smallest period q, at least ``least_periods`` times as long
as q and ``least_words`` long, that no neighbouring word extends. Two places i < j are a
maximal pair of length l if the l words from them are alike, the words before them differ
and the words after them differ. Where l is at least ``least_periods - 1`` times j - i, the
words from i to j + l are just what period j - i covers and nothing extends them: a run needs
no search beyond its pair.

Suffixes are sorted by prefix doubling, in arrays over many texts at once, and the lengths of
their common prefixes follow from the ranks of the doubling. The prefixes are scanned bottom
up with a stack: a node of the interval tree holds the places of its suffixes in order, each
with its class, the word to its left. When a child joins its node, the places of the smaller
side are entered one by one into the larger, and a place and its new neighbours, if of
different classes, are a maximal pair of the node's length. Neighbours suffice: copies of one
string at most half its length apart are a whole period apart and of one class but for the
first, so the pair at the smallest period has nothing between it. Multiples of that period
that show up on the way give the same stretch and lose to it.

Only suffixes whose first ``least_words - least_words // least_periods`` words come again in
the same text can be of such a pair. Texts without any, told by hashes that can only err
towards keeping a text, need no suffixes; the others are sorted exactly.

A text is one task's work, its memory in proportion to its words. Defined results: a null or
empty text has no words and no runs; repeated rows repeat their result; a null ``doc_id``
stays null; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.llm.common import empty_if_null

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that are worked on together; a single longer text is taken alone.
BATCH_WORDS = 300_000
#: Places of a part of a sorted list.
PART = 512
Run = tuple[int, int, int]  # start, length, period


class Places:
    """Places in order, in parts of bounded length."""

    def __init__(self, place: int) -> None:
        self.parts, self.ends, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        return itertools.chain.from_iterable(self.parts)

    def enter(self, place: int) -> tuple[int, int]:
        """Add a place; its neighbours, -1 where there is none."""
        k = min(bisect_left(self.ends, place), len(self.parts) - 1)
        part = self.parts[k]
        at = bisect_left(part, place)
        before = part[at - 1] if at else self.ends[k - 1] if k else -1
        after = part[at] if at < len(part) else -1  # only past the last part's end
        part.insert(at, place)
        self.size += 1
        if after < 0:
            self.ends[k] = place
        if len(part) > 2 * PART:
            self.parts[k:k + 1] = [part[:PART], part[PART:]]
            insort(self.ends, part[PART - 1])
        return before, after


def _alike(words: np.ndarray, depth: int) -> np.ndarray:
    """Places whose next ``depth`` words have the hash of others': a superset of those whose
    words come again."""
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    grams, base = np.zeros(max(0, len(words) - depth + 1), dtype=np.uint64), 0x94D049BB133111EB
    done, power, factor = 0, mixed, base
    size = 1
    while True:  # grams of powers of two, put together by the bits of the depth
        if depth & size:
            scale = np.uint64(pow(base, done, 1 << 64))
            grams += power[done:done + len(grams)] * scale
            done += size
        size *= 2
        if size > depth:
            break
        half = size // 2
        power = power[:-half] + power[half:] * np.uint64(pow(base, half, 1 << 64))
    sorted_ = np.sort(grams)
    twice = np.unique(sorted_[1:][sorted_[1:] == sorted_[:-1]])
    if not len(twice):
        return np.empty(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    return np.flatnonzero(twice[at] == grams)


def _ranked(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and their ranks by their first 1, 2, 4, ... words."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    firsts = np.flatnonzero(np.diff(words[order], prepend=words[order[0]] - 1))
    sizes = np.diff(firsts, append=n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(firsts, sizes)  # a rank is the place of a group's first suffix
    levels, size = [rank.copy()], 1
    open_ = order[np.repeat(sizes > 1, sizes)]
    while len(open_):
        after = open_ + size
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = rank[open_]
        by = np.lexsort((second, first))
        open_, first, second = open_[by], first[by], second[by]
        new = np.ones(len(open_), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.ones(len(open_), dtype=bool)
        group[1:] = first[1:] != first[:-1]
        places = np.arange(len(open_))
        start = np.maximum.accumulate(np.where(group, places, 0))
        order[first + places - start] = open_
        rank[open_] = first + np.maximum.accumulate(np.where(new, places, 0)) - start
        levels.append(rank.copy())
        heads = np.flatnonzero(new)
        open_ = open_[np.repeat(np.diff(heads, append=len(new)) > 1,
                                np.diff(heads, append=len(new)))]
        size *= 2
    return order, levels


def _common(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """Common words of each suffix in order and the one before; 0 where under ``least``."""
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    level = min(len(levels), least.bit_length()) - 1
    near = 1 + np.flatnonzero(levels[level][order[1:]] == levels[level][order[:-1]])
    length, a, b = np.zeros(len(near), dtype=np.int64), order[near], order[near - 1]
    for size, ranks in reversed([(1 << k, ranks) for k, ranks in enumerate(levels)]):
        x, y = a + length, b + length
        inside = np.maximum(x, y) < n
        same = inside & (ranks[np.minimum(x, n - 1)] == ranks[np.minimum(y, n - 1)])
        length += size * same
    out[near] = np.where(length >= least, length, 0)
    return out


def _pairs(order: list[int], common: list[int], left: list[int], ratio: int,
           least_words: int) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs (i, j, length) that can be runs. ``common[k]`` belongs to ``order[k]``
    and the suffix before, and is 0 at the ends of a group."""
    found: list[tuple[int, int, int]] = []

    def check(i: int, j: int, depth: int) -> None:
        if ratio * (j - i) <= depth and depth + j - i >= least_words and left[i] != left[j]:
            found.append((i, j, depth))

    def joined(a: Places, b: Places, depth: int) -> Places:
        large, small = (a, b) if a.size >= b.size else (b, a)
        own = set(small)
        for place in small:
            before, after = large.enter(place)
            if before >= 0 and before not in own:
                check(before, place, depth)
            if after >= 0 and after not in own:
                check(place, after, depth)
        return large

    stack: list[tuple[int, Places]] = []
    last: Places | None = None
    for place, depth in zip(order, common):
        while stack and stack[-1][0] > depth:
            length, held = stack.pop()
            last = joined(held, last, length)
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, joined(stack[-1][1], last, depth))
            else:
                stack.append((depth, last))
        last = Places(place)
    while stack:
        length, held = stack.pop()
        last = joined(held, last, length)
    return iter(found)


def runs_of(texts: list[np.ndarray], least_words: int = LEAST_WORDS,
            least_periods: int = LEAST_PERIODS) -> list[list[Run]]:
    """The runs of every text of word numbers, by start and period."""
    ratio = least_periods - 1
    # A run of period q has a pair of max(least_words - q, ratio * q) words: the least over q.
    depth = min(max(least_words - q, ratio * q) for q in range(1, least_words + 1))
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return out
    # Words of different texts differ, and so do the ends of texts.
    most = 1 + max(int(t.max()) for t in texts if len(t))
    number = np.repeat(np.arange(len(texts)), sizes)
    words = np.concatenate([t.astype(np.int64) for t in texts]) + number * most
    starts = np.cumsum(sizes) - sizes
    if len(words) < depth:
        return out
    alike = _alike(words, depth)
    alike = alike[alike + depth <= (starts + sizes)[number[alike]]]  # inside one text
    kept = np.unique(number[alike])
    if not len(kept):
        return out
    of = np.concatenate([np.append(words[starts[t]:starts[t] + sizes[t]], -1 - t) for t in kept])
    begins = np.cumsum(sizes[kept] + 1) - sizes[kept] - 1
    _, of = np.unique(of, return_inverse=True)
    order, levels = _ranked(of)
    common = _common(order, levels, depth)
    used = common > 0
    used[:-1] |= common[1:] > 0
    left = np.concatenate([[-1], of[:-1]])
    left[begins] = -1 - begins  # nothing is to the left of a text's first word
    covered: dict[tuple[int, int], int] = {}
    for i, j, length in _pairs(order[used].tolist(), common[used].tolist(), left.tolist(),
                               ratio, least_words):
        stretch = (i, j + length)
        covered[stretch] = min(j - i, covered.get(stretch, j - i))
    for (start, end), period in covered.items():
        k = int(np.searchsorted(begins, start, side="right")) - 1
        out[kept[k]].append((start - int(begins[k]), end - start, period))
    for found in out:
        found.sort(key=lambda run: (run[0], run[2]))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words no run holds after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


def find_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
              least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all runs by start and period, and the text's
    words but for those that a run holds after its first period, joined by one space."""
    kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))

    def work(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        split = [t.split() for t in texts]  # ASCII white space alone
        words = [np.fromiter(map(numbers.__getitem__, s), np.int64, len(s)) for s in split]
        found = runs_of(words, least_words, least_periods)
        collapsed = [
            b" ".join(itertools.compress(s, kept_words(len(s), runs)) if runs else s)
            for s, runs in zip(split, found)]
        names = ("start", "length", "period")
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(s) for s in split], pa.int64()),
            pa.array([[dict(zip(names, run)) for run in runs] for runs in found], kind),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for own, held in zip(batch["doc_id"], batch["text"]):
                ids.append(own.as_py())
                texts.append(held.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= 6 * BATCH_WORDS:
                    yield work(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield work(ids, texts)

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text)).alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string")
