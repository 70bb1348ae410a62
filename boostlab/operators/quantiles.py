"""Exact quantiles of many columns by counting digits, the leading ones first.

A double is read as a 64-bit key of the same order. Every pass counts, per column, the
values under each prefix that still holds a wanted rank, by their next digit. Tasks add up
their own rows, and their counts are summed in two steps, by column and lane, then by
column, where the next digit of every rank falls out. So the table is neither sorted nor
shuffled, what tasks exchange is bounded by the digits, and the result does not depend on
partitions. NULL and NaN have no rank.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = "feature int, lane int, at binary, n binary"
DIGITS = "feature int, n long, digits array<int>, ranks array<long>, held array<long>"
BITS = 64
SIGN = np.uint64(1 << 63)
#: Counters of one column, and of all columns of a job, that a task holds: 8 bytes each.
COLUMN_CELLS, TASK_CELLS = 1 << 18, 1 << 23
LANES = 32


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of the values; both zeros have one key."""
    raw = (values + 0.0).view(np.uint64)
    return np.where(raw & SIGN, ~raw, raw | SIGN)


def values_of(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & SIGN, keys ^ SIGN, ~keys).view(np.float64)


class _Search:
    """The prefixes of one column found so far, and the ranks wanted below each."""

    def __init__(self) -> None:
        self.prefixes = np.zeros(1, dtype=np.uint64)
        self.slots: np.ndarray | None = None  # per rank; None before the first pass
        self.ranks: np.ndarray | None = None

    def width(self, done: int) -> int:
        """Bits of the next digit: as many as its counters leave room for."""
        room = COLUMN_CELLS // max(1, len(self.prefixes))
        return max(1, min(BITS - done, room.bit_length() - 1))

    def advance(self, digits: list[int], ranks: list[int], width: int) -> None:
        slots = self.slots if self.slots is not None else np.zeros(len(digits), dtype=np.int64)
        keys = (self.prefixes[slots] << np.uint64(width)) | np.array(digits, dtype=np.uint64)
        self.prefixes, self.slots = np.unique(keys, return_inverse=True)
        self.ranks = np.array(ranks, dtype=np.int64)


def _count_rows(searches: dict[int, _Search], done: int, width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId() % LANES
        cells = {f: np.zeros(len(s.prefixes) << width, dtype=np.int64)
                 for f, s in searches.items()}
        for batch in batches:
            for (f, search), column in zip(searches.items(), batch.columns):
                values = column.to_numpy(zero_copy_only=False)
                keys = ordered_keys(values[~np.isnan(values)])
                digit = (keys << np.uint64(done)) >> np.uint64(BITS - width)
                if done:
                    lead = keys >> np.uint64(BITS - done)
                    slot = np.searchsorted(search.prefixes, lead)
                    known = search.prefixes[np.minimum(slot, len(search.prefixes) - 1)] == lead
                    digit = (slot[known] << width) + digit[known].astype(np.int64)
                np.add.at(cells[f], digit.astype(np.int64), 1)
        filled = {f: np.flatnonzero(c) for f, c in cells.items()}
        yield _count_batch([(f, lane, at, cells[f][at]) for f, at in filled.items() if len(at)])

    return count


def _count_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2].astype(np.int32).tobytes() for r in rows], pa.binary()),
            pa.array([r[3].tobytes() for r in rows], pa.binary()),
        ],
        names=["feature", "lane", "at", "n"],
    )


def _summed(batches: Iterator[pa.RecordBatch], sizes: dict[int, int]):
    """Counters per (feature, lane) of all rows read."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        keys = zip(batch["feature"].to_pylist(), batch["lane"].to_pylist())
        for key, at, n in zip(keys, batch["at"], batch["n"]):
            if key not in sums:
                sums[key] = np.zeros(sizes[key[0]], dtype=np.int64)
            sums[key][np.frombuffer(at.as_buffer(), dtype=np.int32)] += np.frombuffer(
                n.as_buffer(), dtype=np.int64)
    return sums


def _next_digits(
    rows: DataFrame, searches: dict[int, _Search], done: int, width: int, parts: int
) -> list:
    """One pass: per column the next digit of every rank, the rank below the longer prefix
    and the values under it."""
    sizes = {f: len(s.prefixes) << width for f, s in searches.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*key, at, cells[at]) for key, cells in _summed(batches, sizes).items()
                for at in [np.flatnonzero(cells)]]
        yield _count_batch(rows)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for (f, _), cells in _summed(batches, sizes).items():
            grid = cells.reshape(-1, 1 << width)
            slots, ranks = searches[f].slots, searches[f].ranks
            n = int(cells.sum())
            if slots is None:  # rank k of the parts is the first with k / parts at or below it
                ranks = np.array([max(1, -(-k * n // parts)) for k in range(1, parts)])
                slots = np.zeros(len(ranks), dtype=np.int64)
            upto = np.cumsum(grid, axis=1)
            digits = np.empty(len(ranks), dtype=np.int64)
            for slot in np.unique(slots):
                own = slots == slot
                digits[own] = np.searchsorted(upto[slot], ranks[own])
            held = grid[slots, digits]
            made.append((f, n, digits, ranks - (upto[slots, digits] - held), held))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([m[0] for m in made], pa.int32()),
                pa.array([m[1] for m in made], pa.int64()),
                pa.array([m[2].tolist() for m in made], pa.list_(pa.int32())),
                *(pa.array([m[i].tolist() for m in made], pa.list_(pa.int64())) for i in (3, 4)),
            ],
            names=["feature", "n", "digits", "ranks", "held"],
        )

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.select(*[f"c{f}" for f in searches])
        .mapInArrow(_count_rows(searches, done, width), COUNTS)
        .repartition(min(partitions, LANES * len(searches)), "feature", "lane")
        .mapInArrow(add, COUNTS)
        .withColumn("lane", F.lit(0))
        .repartition(min(partitions, len(searches)), "feature")
        .mapInArrow(pick, DIGITS)
        .collect()  # one row per column
    )


def quantiles(
    df: DataFrame, columns: Sequence[str], parts: int, balance: bool = False
) -> dict[str, list[float]]:
    """Per column the distinct values that cut its rows into ``parts`` equal parts: for
    k = 1, ..., parts - 1 the smallest value with at least k / parts of the values at or
    below it.

    With ``balance`` the search ends as soon as no prefix holds more than two parts of the
    values, or all digits are known: the cuts then are lower bounds of such prefixes,
    no values of the table, which is enough to deal rows evenly.
    """
    if parts < 2 or not columns:
        return {c: [] for c in columns}
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    found: dict[str, list[float]] = {}
    try:
        at_once = max(1, TASK_CELLS // COLUMN_CELLS)
        for first in range(0, len(columns), at_once):
            portion = range(first, min(first + at_once, len(columns)))
            searches = {f: _Search() for f in portion}
            done, total = 0, {}
            while searches and done < BITS:
                width = min(s.width(done) for s in searches.values())
                answers = {r["feature"]: r for r in _next_digits(rows, searches, done, width, parts)}
                total = total or {f: r["n"] for f, r in answers.items()}
                for f in [f for f in searches if f not in answers]:  # a column without values
                    del searches[f]
                    found[columns[f]] = []
                for f, row in answers.items():
                    searches[f].advance(row["digits"], row["ranks"], width)
                done += width
                if balance and all(max(answers[f]["held"]) * parts <= 2 * total[f] for f in answers):
                    break
            for f, search in searches.items():
                keys = search.prefixes << np.uint64(BITS - done)
                found[columns[f]] = values_of(keys).tolist()
    finally:
        rows.unpersist()
    return found
