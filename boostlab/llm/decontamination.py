"""Benchmark passages in documents, found by the n-grams of the test items.

Texts are normalised to their words. A window is ``n`` consecutive words of an item; a
shorter item is one window. The items' words and windows form a set that is broadcast when
the items hold at most ``broadcast_chars`` characters (counted first). Tasks then slide over
the words of whole documents: hashes of windows are looked up in the sorted hashes of the
set, and every hit is verified word by word. A larger benchmark is joined by window hash
instead, with the same verification, and gives the same rows.

Defined results: a null text has no words; an item without words has no window; a null
``item_id`` counts as the empty id; repeated items count once; a repeated document row
repeats its result, and a document with a null id has one; empty documents give no rows, an
empty benchmark no hits; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.llm.common import (
    ALNUM_WORD,
    empty_if_null,
    lowered_bytes,
    numbered,
    settled,
)

WINDOW = 10
#: Largest benchmark that is broadcast; some hundred bytes of memory per word.
BROADCAST_CHARS = 8_000_000
#: Lots of a joined window.
LOTS = 16
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5) % 2**64 | 1 for i in range(64)],
                dtype=np.uint64)


def _windows(words: list[bytes], n: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        size = min(n, len(words))
        for at in range(len(words) - size + 1):
            yield tuple(words[at:at + size])


def _hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` word numbers."""
    out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for j in range(size):
        out += ids[j:len(ids) - size + 1 + j] * _MIX[j % 64] + np.uint64(j)
        out ^= out >> np.uint64(29)
    return out


class NgramSet:
    """The words and windows of a bounded benchmark."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item_id, text in items:
            for window in _windows(ALNUM_WORD.findall(lowered_bytes(text)), n):
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window)
                self.items.setdefault(len(key), {}).setdefault(key, set()).add(item_id)
        self.keys = {
            size: np.unique(np.concatenate(
                [_hashes(np.array(key, dtype=np.uint64), size) for key in found]))
            for size, found in self.items.items()
        }

    def scan(self, words: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """Verified hits: place, number of words, items."""
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        hits = []
        for size, keys in self.keys.items():
            if len(ids) < size:
                continue
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            full = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(full):
                continue
            hashes = _hashes(ids, size)[full]
            near = keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)]
            for at in full[near == hashes].tolist():
                items = self.items[size].get(tuple(ids[at:at + size].tolist()))
                if items:
                    hits.append((at, size, items))
        return hits


def _covered(hits: list[tuple[int, int, set[str]]], n_words: int) -> np.ndarray:
    steps = np.zeros(n_words + 1, dtype=np.int64)
    for at, size, _ in hits:
        steps[at] += 1
        steps[at + size] -= 1
    return np.cumsum(steps[:-1]) > 0


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text)).alias("text"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        empty_if_null(F.col("text")).alias("text"))


def _bounded_set(benchmark: DataFrame, n: int, broadcast_chars: int) -> NgramSet | None:
    items = _items(benchmark)
    size = items.agg(F.sum(F.length("text") + F.length("item_id") + 8)).first()[0] or 0
    if size > broadcast_chars:
        return None
    return NgramSet([tuple(r) for r in items.collect()], n)


def find(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text",
    doc_id: str = "doc_id", broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    grams = _bounded_set(benchmark, n, broadcast_chars)
    if grams is None:
        return _find_joined(docs, benchmark, n, text, doc_id)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for body in frame["text"]:
                words = ALNUM_WORD.findall(lowered_bytes(body))
                rows.append(_judged(words, shared.value.scan(words)))
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])
            made.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    return _rows(docs, text, doc_id).mapInPandas(scan, f"doc_id long, {_FOUND}")


def _window_rows(n: int, sizes: list[int], item: bool):
    """Windows by their hash, size and place; those of items with their words."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for frame in frames:
            for at in range(0, len(frame), 64):
                part, rows = frame.iloc[at:at + 64], []
                for own, body in zip(part.iloc[:, 0], part["text"]):
                    words = ALNUM_WORD.findall(lowered_bytes(body))
                    for size in ([min(n, len(words))] if item else sizes):
                        if not size or size > len(words):
                            continue
                        for place in range(len(words) - size + 1):
                            gram = b" ".join(words[place:place + size])
                            rows.append((own, place, size, xxhash.xxh3_64_intdigest(gram) - 2**63,
                                         gram if item else None))
                yield pd.DataFrame(rows, columns=["own", "place", "size", "hash", "words"])

    return cut


_WINDOW = "own {}, place int, size int, hash long, words binary"
_HIT = "array<struct<place: int, size: int, words: binary, items: array<string>>>"


def _hits_joined(rows: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """``row`` and its ``hits``, for a benchmark too large to broadcast: rows (``row, text``)
    whose windows, of the sizes the benchmark has, hash like some of its own.

    A document's windows travel as hashes alone. Windows of the benchmark are copied to
    ``LOTS`` lots and rows dealt to them, so a passage of very many documents is met by
    several tasks. Hits are verified by the words, where the text is (:func:`_verified`).
    """
    wanted = settled(
        _items(benchmark).mapInPandas(_window_rows(n, [], True), _WINDOW.format("string"))
        .groupBy("size", "hash", "words").agg(F.collect_set("own").alias("items")))
    sizes = [r["size"] for r in wanted.select("size").distinct().collect()]  # n at most
    found = rows.select("row", "text").mapInPandas(
        _window_rows(n, sizes, False), _WINDOW.format("long")).select(
        "own", "place", "size", "hash", F.pmod(F.xxhash64("own"), F.lit(LOTS)).alias("lot"))
    copied = wanted.withColumn(
        "lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOTS - 1).cast("long"))))
    hits = found.join(copied, ["size", "hash", "lot"])
    return hits.groupBy(F.col("own").alias("row")).agg(
        F.collect_list(F.struct("place", "size", "words", "items")).alias("hits"))


def _verified(words: list[bytes], hits) -> list[tuple[int, int, set[str]]]:
    """Hits whose words are the text's: place, number of words, items."""
    return [
        (h["place"], h["size"], set(h["items"])) for h in (() if hits is None else hits)
        if b" ".join(words[h["place"]:h["place"] + h["size"]]) == h["words"]]


def _find_joined(docs: DataFrame, benchmark: DataFrame, n: int, text: str,
                 doc_id: str) -> DataFrame:
    """The same for a benchmark too large to broadcast."""
    rows = numbered(_rows(docs, text, doc_id))
    hits = _hits_joined(rows, benchmark, n).withColumnRenamed("row", "own")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for body, own in zip(frame["text"], frame["hits"]):
                words = ALNUM_WORD.findall(lowered_bytes(body))
                made.append(_judged(words, _verified(words, own)))
            out = pd.DataFrame(made, columns=[c.split()[0] for c in _FOUND.split(", ")])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return rows.join(hits, rows["row"] == hits["own"], "left").select(
        "doc_id", "text", "hits").mapInPandas(judge, f"doc_id long, {_FOUND}")


def _judged(words: list[bytes], hits: list[tuple[int, int, set[str]]]) -> tuple:
    items = set().union(*(h[2] for h in hits)) if hits else ()
    n_hit = int(_covered(hits, len(words)).sum()) if hits else 0
    return len(words), n_hit, len(items), _digest(items), n_hit > 0


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text",
    broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """The documents, all columns, with the hit words cut out of their texts.

    Everything between two neighbouring hit words goes with them; a text without hits is
    left as it is. Benchmarks of any size: beyond the broadcast bound hits are joined.
    """
    grams = _bounded_set(benchmark, n, broadcast_chars)
    if grams is None:
        return _remove_joined(docs, benchmark, n, text)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([_cut(body, shared.value.scan) for body in texts], dtype=object)

    return docs.withColumn(text, cut(F.col(text)))


def _remove_joined(docs: DataFrame, benchmark: DataFrame, n: int, text: str) -> DataFrame:
    row, own = (_free(name, docs.columns) for name in ("row", "hits"))
    marked = settled(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = _hits_joined(
        marked.select(F.col(row).alias("row"), empty_if_null(F.col(text)).alias("text")),
        benchmark, n).select(F.col("row").alias(f"{row}_"), F.col("hits").alias(own))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([
            _cut(body, lambda words, found=found: _verified(words, found))
            for body, found in zip(texts, hits)], dtype=object)

    met = marked.join(hits, F.col(row) == F.col(f"{row}_"), "left")
    return met.withColumn(text, F.when(F.col(own).isNull(), F.col(text)).otherwise(
        cut(F.col(text), F.col(own)))).select(*docs.columns)


def _free(name: str, taken: list[str]) -> str:
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def _cut(body: str | None, scan) -> str | None:
    """A text without the words of the hits that ``scan`` finds among its words."""
    raw = body.encode("utf-8", "surrogatepass") if body is not None else b""
    places = [m.span() for m in ALNUM_WORD.finditer(raw.lower())]
    hits = scan([raw[a:b].lower() for a, b in places])
    if not hits:
        return body
    hit = np.flatnonzero(np.diff(np.concatenate(
        ([0], _covered(hits, len(places)).astype(np.int8), [0]))))
    kept, at = [], 0
    for first, last in zip(hit[::2], hit[1::2]):
        kept.append(raw[at:places[first][0]])
        at = places[last - 1][1]
    return (b"".join(kept) + raw[at:]).decode("utf-8", "surrogatepass")
