"""Byte-pair encoding and decoding of whole texts by contiguous rank arrays.

A word is held as the ids of the parts between its boundaries, beside the rank of every two
adjacent parts. The least rank is found by scanning, the boundary between its parts is
deleted, and the ranks of the two neighbours are looked up anew, until no adjacent parts have
a rank. Words of similar length are rows of one array and go through these steps together:
one scan finds the least rank of every row. Words of more than ``SHORT`` bytes keep the same
ranks in a heap, which merges in the same order (least rank, then leftmost) without a scan
per merge.

Texts are split at the special strings first, then into words by the published pattern. Where
a text has other than plain characters, stretches that no word crosses (white space, of which
one space may go to what follows) are split one by one, and those that are not plain by the
tokenizer's own splitter, as only it has its Unicode tables. Words met lately are remembered
(a bounded number of short ones), so a frequent word is merged once.

Defined results: a null text is empty and has no ids; repeated rows repeat their result; a
null ``doc_id`` stays null; an empty table gives no rows; other columns are not looked at. In
decoding a null list is empty, and ids that no token has are left out.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.llm.common import empty_if_null

#: Bytes up to which a word is merged by scanning, and words that make an array worth it.
SHORT, TOGETHER = 128, 48
#: Stretches and words that a worker remembers before it forgets those it has not met for as
#: many, and the characters of the longest of them.
REMEMBERED, REMEMBERED_CHARS = 600_000, 48
#: Characters of texts whose unknown words are merged together.
GROUP_CHARS = 1_500_000
#: Ids or bytes of an output batch; a single longer text is a batch of its own.
BATCH_UNITS = 4_000_000
#: White space as the splitting pattern knows it: the characters of Unicode's White_Space.
_SPACE = "\t-\r \x85\xa0  -     　"
_STRETCH = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Characters whose classes no Unicode version changes, and the letters and numbers of them.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Fixed value: the published splitting pattern of byte-level vocabularies, over plain
#: characters. (Words of letters come first, as no other kind can start like them.)
_WORD = re.compile(
    rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_NUMBERS}]+"
    rf"| ?[^\t\n\r {_LETTERS}{_NUMBERS}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_NONE = 1 << 60
_made: dict[str, Bpe] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are
    their own letters, the others have the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted({*range(256)} - {*printable})
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class _PairTable:
    """Ranks of many pairs at once: open addressing over arrays."""

    def __init__(self, ranks: dict[int, int]) -> None:
        self.bits = max(4, (8 * len(ranks)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, dtype=np.int64)
        left = np.fromiter(ranks, dtype=np.int64, count=len(ranks))
        values = np.fromiter(ranks.values(), dtype=np.int64, count=len(ranks))
        self.probes, slots = 0, self._slots(left)
        while len(left):
            self.probes += 1
            free = self.keys[slots] < 0
            self.keys[slots[free]] = left[free]
            stays = self.keys[slots] == left  # of several for one slot, the last one
            self.ranks[slots[stays]] = values[stays]
            left, values = left[~stays], values[~stays]
            slots = (slots[~stays] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], _NONE)
        for step in range(1, self.probes):
            at = (slots + step) & ((1 << self.bits) - 1)
            out = np.where(self.keys[at] == keys, self.ranks[at], out)
        return out


class Bpe:
    """A vocabulary file of the byte-level kind, ready to encode and decode."""

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as held:
            spec = json.load(held)
        split, model = spec["pre_tokenizer"], spec["model"]
        known = split and split["type"] == "ByteLevel" and split.get("use_regex", True)
        if not known or split["add_prefix_space"] or spec["normalizer"] or model["dropout"]:
            raise ValueError("only plain byte-level vocabularies are understood")
        letters = self.letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        ids = {raw(token): i for token, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        self.width = 1 + max(ids.values())
        self.merged = [ids[a + b] for a, b in pairs]  # by rank
        self.ranks = {ids[a] * self.width + ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.first = [self.ranks.get(a * self.width + b, _NONE)
                      for a in self.single for b in self.single]  # of two bytes
        self.pairs = _PairTable(self.ranks)
        self.bytes_of = {i: token for token, i in ids.items()}
        self.specials = {}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("special strings that look at their neighbours")
            self.specials[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode("utf-8")
        self.special_ids = {s: i.to_bytes(4, "little") for s, i in self.specials.items()}
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.merged_ids = np.array([*self.merged, 0], dtype=np.int64)
        self.single_ids = np.array(self.single, dtype=np.int64)
        self.first_ranks = np.array(self.first, dtype=np.int64)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of every word."""
        out: list[bytes] = [b""] * len(words)
        widths: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = _packed(self._heap(word))
            else:
                widths.setdefault(max(3, (len(word) - 1).bit_length()), []).append(i)
        for bits, places in widths.items():
            if len(places) < TOGETHER:
                for i in places:
                    out[i] = _packed(self._scan(words[i]))
            else:
                found = self._scan_together([words[i] for i in places], 1 << bits)
                for i, ids in zip(places, found):
                    out[i] = ids
        return out

    def _scan_together(self, words: list[bytes], width: int) -> list[bytes]:
        """:meth:`_scan` of many words of up to ``width`` bytes, one row each. A boundary is
        deleted by linking the parts on both sides of it; ``ranks[:, i]`` belongs to the part
        that starts at byte ``i`` and the next one."""
        n = len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        held = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8)
        held = held.reshape(n, width).astype(np.int64)
        at = np.arange(width)
        parts = self.single_ids[held]
        parts[at[None, :] >= sizes[:, None]] = -1
        ranks = np.full((n, width), _NONE, dtype=np.int64)
        ranks[:, :-1] = self.first_ranks[(held[:, :-1] << 8) | held[:, 1:]]
        ranks[at[None, :] >= sizes[:, None] - 1] = _NONE
        after = np.broadcast_to(at + 1, (n, width)).copy()
        before = np.broadcast_to(at - 1, (n, width)).copy()
        done_parts, rows = np.full((n, width), -1, dtype=np.int64), np.arange(n)
        while len(rows):
            start = ranks.argmin(axis=1)
            own = np.arange(len(rows))
            least = ranks[own, start]
            open_ = least < _NONE
            if not open_.all():
                done_parts[rows[~open_]] = parts[~open_]
                rows, sizes, start, least = rows[open_], sizes[open_], start[open_], least[open_]
                parts, ranks, after, before = (m[open_] for m in (parts, ranks, after, before))
                own = np.arange(len(rows))
                if not len(rows):
                    break
            middle = after[own, start]
            end = after[own, middle]
            parts[own, start] = self.merged_ids[least]
            parts[own, middle] = -1
            ranks[own, middle] = _NONE
            after[own, start] = end
            inside = end < sizes
            before[own[inside], end[inside]] = start[inside]
            ranks[own, start] = _NONE
            ranks[own[inside], start[inside]] = self.pairs.get(
                parts[own[inside], start[inside]] * self.width + parts[own[inside], end[inside]])
            led = start > 0
            first = before[own[led], start[led]]
            ranks[own[led], first] = self.pairs.get(
                parts[own[led], first] * self.width + parts[own[led], start[led]])
        alive = done_parts >= 0
        ids = done_parts[alive].astype("<i4").tobytes()
        ends = 4 * np.cumsum(alive.sum(axis=1))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _scan(self, word: bytes) -> list[int]:
        """``ranks[i]`` belongs to the boundary between ``parts[i]`` and ``parts[i + 1]``."""
        single, first, width = self.single, self.first, self.width
        rank_of, merged = self.ranks.get, self.merged
        parts = [single[b] for b in word]
        ranks = [first[(a << 8) | b] for a, b in zip(word, word[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] * width + parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] * width + parts[i], _NONE)
        return parts

    def _heap(self, word: bytes) -> list[int]:
        """The same merges of a long word: parts by where they start, ranks in a heap."""
        n, width, merged = len(word), self.width, self.merged
        parts = [self.single[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        current = [_NONE] * n
        heap: list[tuple[int, int]] = []

        def refresh(start: int) -> None:
            end, rank = after[start], _NONE
            if end < n:
                rank = self.ranks.get(parts[start] * width + parts[end], _NONE)
                if rank != _NONE:
                    heapq.heappush(heap, (rank, start))
            current[start] = rank

        for start in range(n):
            refresh(start)
        while heap:
            rank, start = heapq.heappop(heap)
            if current[start] != rank:
                continue  # the parts changed since
            middle = after[start]
            parts[start] = merged[rank]
            current[middle] = _NONE
            after[start] = after[middle]
            before[after[start]] = start
            refresh(start)
            if start:
                refresh(before[start])
        out, at = [], 0
        while at < n:
            out.append(parts[at])
            at = after[at]
        return out

    def _words_of(self, text: str) -> list[str | bytes]:
        """The words of a text without special strings, as bytes where the tokenizer's own
        splitter made them."""
        if _PLAIN.fullmatch(text):
            return _WORD.findall(text)
        words, letters = [], self.letters
        for stretch in _STRETCH.findall(text):
            if _PLAIN.fullmatch(stretch):
                words += _WORD.findall(stretch)
            else:
                words += [bytes([letters[c] for c in word])
                          for word, _ in self.splitter.pre_tokenize_str(stretch)]
        return words

    def _split(self, text: str) -> list[str | bytes]:
        """Words and special strings of a text, in order."""
        if self.special is None or not self.special.search(text):
            return self._words_of(text)
        out, at = [], 0
        for hit in self.special.finditer(text):
            out += [*self._words_of(text[at:hit.start()]), hit.group()]
            at = hit.end()
        return out + self._words_of(text[at:])

    def _learn(self, words: set[str | bytes]) -> dict[str | bytes, bytes]:
        """Remember the ids of words; those of words too long for that are given back."""
        if len(self.new) >= REMEMBERED // 2:
            self.new, self.old = {}, self.new
        fresh, new, old = [], self.new, self.old
        for word in words:
            if word not in new:
                found = old.get(word)
                if found is None:
                    fresh.append(word)
                else:
                    new[word] = found
        ids = self.merge([w if isinstance(w, bytes) else w.encode("utf-8") for w in fresh])
        long = {}
        for word, found in zip(fresh, ids):
            (new if len(word) <= REMEMBERED_CHARS else long)[word] = found
        return long

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of whole texts, in order."""
        for group in _in_batches(texts, len, GROUP_CHARS):
            split = [self._split(text) for text in group]
            own = self.special_ids | self._learn(set().union(*split).difference(self.specials))
            known = self.new
            for words in split:
                try:
                    yield b"".join([known[w] for w in words])
                except KeyError:  # special strings, or words too long to be remembered
                    yield b"".join([own[w] if w in own else known[w] for w in words])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special strings included; bytes that are no UTF-8 are replaced."""
        known = self.bytes_of
        try:
            joined = b"".join([known[i] for i in ids])
        except KeyError:
            joined = b"".join([known[i] for i in ids if i in known])
        return joined.decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _bpe(path: str) -> Bpe:
    """One vocabulary per Python worker."""
    if path not in _made:
        _made[path] = Bpe(path)
    return _made[path]


def _in_batches(made: Iterable, units, most: int) -> Iterator[list]:
    """Lists of what was made, of bounded size (a single larger one is a list of its own)."""
    held, size = [], 0
    for one in made:
        held.append(one)
        size += units(one)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, tokenizer: str, text: str = "text",
           doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` of every text, without begin, end or added special tokens; a special
    string inside a text is its one id. ``tokenizer`` is a ``.json`` file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _bpe(tokenizer)
        for batch in batches:
            texts = enumerate(own.encode(t.as_py() for t in batch["text"]))
            for rows in _in_batches(texts, lambda row: len(row[1]) // 4, BATCH_UNITS):
                ids = np.frombuffer(b"".join([held for _, held in rows]), dtype="<i4")
                ends = np.cumsum([0, *[len(held) // 4 for _, held in rows]])
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(rows[0][0], len(rows)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                ], names=["doc_id", "ids"])

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids",
           doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids, text``: the text of every list of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _bpe(tokenizer)
        for batch in batches:
            lists = batch["ids"]
            texts = ((at, own.decode(held.values.to_pylist())) for at, held in enumerate(lists))
            for rows in _in_batches(texts, lambda row: len(row[1]), BATCH_UNITS):
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(rows[0][0], len(rows)),
                    lists.slice(rows[0][0], len(rows)),
                    pa.array([t for _, t in rows], pa.string()),
                ], names=["doc_id", "ids", "text"])

    rows = encoded.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.array_compact(F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))
        .alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
