"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

Tokens come from the given tokenizer with one end id after each document. Only documents
longer than a sequence are cut, into pieces of a whole sequence and a last, shorter one.

Within a packing group every piece goes where the sum over residual gaps of the squared
number of open sequences with that gap becomes smallest: taking one from gap g to gap
g - s changes the sum by 2 * (N[g - s] - N[g] + 1), filling one exactly by 1 - 2 * N[g].
Longer pieces go first, ties go to the smaller gap, and a new sequence is opened only when
no open one has room, as the aim is few sequences.

Groups are dealt at random and hold about ``group_pieces`` pieces each, so their number
follows the data; each is one task's work and leaves a handful of part-filled sequences.

Words are encoded once per task and remembered (with a bound on how many): the tokenizer
drops white space and encodes each of its words alone, so a text has the ids of its words.

Defined results: a null or empty text is the end id alone; repeated rows are packed as rows
of their own; a null ``doc_id`` stays null; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.llm.common import empty_if_null, settled

CAPACITY, END_ID = 2048, 0
GROUP_PIECES = 50_000
#: Words after which a worker forgets those it has not met for as many.
REMEMBERED = 250_000
RUN_WORDS = 20_000
#: Characters for which lower-casing, composition and the classes of the splitting pattern
#: are the same letter by letter in Python and in the tokenizer.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ɏ]+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_made: dict = {}


class _Recent:
    """A bounded memory: what was used since the last but one clearing."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """The keys not held; those found are held anew."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        fresh, new = [], self.new
        for key in [k for k in keys if k not in new]:
            found = self.old.get(key)
            if found is None:
                fresh.append(key)
            else:
                new[key] = found
        return fresh


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    for themselves, the others for code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Ids:
    """Little-endian 32-bit ids of texts, with the words seen lately remembered."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
        self.letters = _byte_letters()
        self.words, self.chunks = _Recent(REMEMBERED), _Recent(REMEMBERED)

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One word of the splitting pattern, by the tokenizer's merges alone."""
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode("utf-8")])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        split: dict[bytes, Sequence[str]] = {}
        for chunk in chunks:
            text = chunk.decode("utf-8")
            if text.isalpha() and text.isascii():
                split[chunk] = (text.lower(),)
            elif _PLAIN.fullmatch(text) and not self.special.search(text):
                split[chunk] = _WORDS.findall(text.lower())
            else:
                self.chunks.new[chunk] = self._encode(text)
        for word in self.words.missing({w for words in split.values() for w in words}):
            self.words.new[word] = self._word(word)
        known = self.words.new
        for chunk, words in split.items():
            self.chunks.new[chunk] = b"".join([known[w] for w in words])

    def of(self, texts: list[str]) -> list[bytes]:
        out, run, size = [], [], 0
        for text in texts:  # some thousand words at a time, so the memory stays bounded
            run.append(text.encode("utf-8").split())
            size += len(run[-1])
            if size >= RUN_WORDS:
                out += self._run(run)
                run, size = [], 0
        return out + self._run(run)

    def _run(self, run: list[list[bytes]]) -> list[bytes]:
        self._learn(self.chunks.missing(set().union(*run)))
        known = self.chunks.new
        return [b"".join([known[c] for c in words]) for words in run]


def _ids(path: str) -> _Ids:
    if path not in _made:
        _made[path] = _Ids(path)
    return _made[path]


def pieces(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    end = int(end_id).to_bytes(4, "little")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for own, ids in zip(frame["doc_id"].astype("Int64"),
                                _ids(tokenizer).of(list(frame["text"]))):
                ids += end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((own, number, at // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(
                rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text)).alias("text")
    )
    return rows.mapInPandas(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece by the sum-of-squares rule."""
    order = np.argsort(-lengths, kind="stable")
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    opened = np.zeros(capacity + 1)  # by gap; the gap 0 stays at 0: a full one is not open
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in order:
        size = int(lengths[i])
        gap, fits = capacity, np.flatnonzero(opened[size:])
        if len(fits):
            gaps = fits + size
            change = 2 * (opened[gaps - size] - opened[gaps] + 1) - (gaps == size)
            gap = int(gaps[np.argmin(change)])
            own = holders[gap].pop()
            opened[gap] -= 1
        else:
            own, used = used, used + 1
        sequence[i], offset[i] = own, capacity - gap
        if gap > size:
            opened[gap - size] += 1
            holders[gap - size].append(own)
    return sequence, offset


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
    capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """:func:`pieces` with sequence_id and offset, gapless from 0 within each sequence."""
    found = settled(pieces(docs, tokenizer, text, doc_id, capacity, end_id))
    groups = max(1, -(-found.count() // group_pieces))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = place(frame["length"].to_numpy(), capacity)
        group = int(frame["group"].iloc[0])
        return frame.drop(columns="group").assign(
            doc_id=frame["doc_id"].astype("Int64"),
            sequence_id=(group << 32) + sequence, offset=offset)

    dealt = found.withColumn(
        "group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(
        fill, "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long")
