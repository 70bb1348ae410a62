"""Hard negatives for anchors by exact integer products, several candidates a multiplication.

Components become integers, ``floor(scale * x)``. Candidates are packed by Kronecker's
substitution: their components, biased to be at least 0, go to separate fields of one wide
integer per component. An anchor component (biased too) then multiplies all the fields of a
word at once, the words of all components are added, and every field holds one candidate's
product, from which the biases are taken off. Fields are as wide as the largest product of
the block needs, so none runs over into the next. Words of up to 53 bits are kept as doubles,
in which such integers and all sums of them are exact and matrix units multiply them; where
two fields do not fit, words are Python integers of ``WIDE`` fields, whatever their width.

Anchors (rows whose id is a multiple of ``every``) and rows are dealt to blocks by a number
of their own, and each block of anchors meets each block of rows in one task: an anchor's
work is never one group, and a label or id of a third of all rows is spread like any other.
A first pass keeps an anchor's best rows of its label, a second one, for each of these
positives, the best rows of other labels between the shares of its score. Blocks send at most
the wanted number of rows per anchor (and positive), which a window merges.

Defined results: rows with a null label, a null id, a null vector, or a null or non-finite
component take no part; a shorter vector counts as filled up with zeros; the same id on
several rows makes each a row of its own, but none of them is another's positive; equal
scores go by the smaller id; an anchor without positives, and a positive without negatives,
has no rows; scores beyond 64 bits are ordered exactly and given as the nearest 64-bit
number; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlab.llm.common import settled

#: Rows of a block of anchors and of a block of candidates; small tables have smaller blocks
#: of candidates, so that all cores have one.
ANCHORS, CANDIDATES, LEAST_CANDIDATES = 32_768, 32_768, 2_048
#: Anchor-candidate products held at once.
HELD_PRODUCTS = 4_000_000
#: Bits of integers that doubles hold, and fields of a word where two do not fit.
EXACT_BITS, WIDE = 53, 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def scaled(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Integer components [row, component], as 64-bit ones where products surely fit and as
    Python integers else."""
    held = vectors.combine_chunks()
    values = held.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    with np.errstate(over="ignore"):
        whole = np.floor(out * scale)
    if not len(sizes) or np.abs(whole).max(initial=0) < 2.0 ** 24:
        return whole.astype(np.int64)

    def exact(x: float, y: float) -> int:
        # Beyond 2**53 a double is an integer; its product is taken as one.
        return int(x) * int(scale) if not math.isfinite(y) else int(y)

    return np.array([[exact(x, y) for x, y in zip(*rows)] for rows in zip(out, whole)],
                    dtype=object).reshape(whole.shape)


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products [anchor, candidate] by packed words."""
    size = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = (
        np.pad(m, ((0, 0), (0, size - m.shape[1]))) for m in (anchors, candidates))
    if not anchors.size or not candidates.size:
        return np.zeros((len(anchors), len(candidates)), dtype=np.int64)
    low_a, low_c = (min(int(m.min()), 0) for m in (anchors, candidates))
    a, c = anchors - low_a, candidates - low_c  # both at least 0
    width = max(1, (size * int(a.max()) * int(c.max())).bit_length())
    fields = EXACT_BITS // width
    if fields >= 2:
        held = _by_doubles(a, c, width, fields)
    else:
        held = _by_wide(a, c, width)
    # (a + A)(c + C) = ac + C sum(a) + A sum(c + C), with A = -low_a and C = -low_c
    sum_a, sum_c = (m.astype(held.dtype).sum(axis=1) for m in (anchors, c))
    return held + low_c * sum_a[:, None] + low_a * sum_c[None, :]


def _by_doubles(a: np.ndarray, c: np.ndarray, width: int, fields: int) -> np.ndarray:
    words = -(-len(c) // fields)
    padded = np.zeros((words * fields, c.shape[1]), dtype=np.int64)
    padded[:len(c)] = c
    shifts = np.left_shift(1, width * np.arange(fields, dtype=np.int64))
    packed = (padded.reshape(words, fields, -1) * shifts[None, :, None]).sum(axis=1)
    added = (a.astype(float) @ packed.T.astype(float)).astype(np.int64)
    mask = (1 << width) - 1
    out = np.empty((len(a), words, fields), dtype=np.int64)
    for field in range(fields):
        out[:, :, field] = (added >> (width * field)) & mask
    return out.reshape(len(a), -1)[:, :len(c)]


def _by_wide(a: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
    mask = (1 << width) - 1
    out = np.empty((len(a), len(c)), dtype=object)
    for first in range(0, len(c), WIDE):
        some = c[first:first + WIDE]
        words = [sum(int(x) << (width * i) for i, x in enumerate(column)) for column in some.T]
        for i, anchor in enumerate(a):
            added = sum(int(x) * word for x, word in zip(anchor, words))
            out[i, first:first + len(some)] = [
                (added >> (width * k)) & mask for k in range(len(some))]
    return out


def _keys(scores: np.ndarray) -> np.ndarray:
    """One number per candidate that orders by score and then by place, the earlier first."""
    n = scores.shape[1]
    if scores.dtype != object:
        most = max(abs(int(scores.max(initial=0))), abs(int(scores.min(initial=0))))
        if (most + 1) * n > _MOST:
            scores = scores.astype(object)
    return scores * n + (n - 1 - np.arange(n, dtype=np.int64))[None, :]


class _Block:
    """A block's rows as arrays, ordered by id, or by label and id."""

    def __init__(self, table: pa.Table, scale: float, by_label: bool) -> None:
        labels, ids = (table[c].to_numpy().astype(np.int64) for c in ("label", "id"))
        order = np.lexsort((ids, labels)) if by_label else np.argsort(ids, kind="stable")
        self.labels, self.ids = labels[order], ids[order]
        self.comps = scaled(table["vector"], scale)[order]
        self.rows = table["row"].to_numpy()[order]
        self.order = order

    def __len__(self) -> int:
        return len(self.ids)


def _slices(n: int, width: int) -> Iterator[slice]:
    each = max(1, HELD_PRODUCTS // max(1, width))
    for at in range(0, n, each):
        yield slice(at, min(n, at + each))


def _best(keys: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest keys of every row, descending."""
    if keys.dtype == object:
        return np.array([sorted(row, reverse=True)[:most] for row in keys], dtype=object)
    if keys.shape[1] > most:
        keys = np.partition(keys, keys.shape[1] - most, axis=1)[:, -most:]
    return -np.sort(-keys, axis=1)


POSITIVE = "anchor long, anchor_id long, place long, positive_id long, score string"
NEGATIVE = ("anchor long, anchor_id long, place long, positive_id long, positive_score string, "
            "negative_id long, score string")


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.table({name: pa.array(column, kinds[kind])
                     for (name, kind), column in zip(fields, columns)})


def _positives(scale: float, wanted: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], POSITIVE)
        anchors, rows = (_Block(t, scale, by_label=True) for t in (left, right))
        out = []
        for label in np.unique(anchors.labels):
            own = np.flatnonzero(anchors.labels == label)
            first, last = np.searchsorted(rows.labels, [label, label + 1])
            n = last - first
            if not n:
                continue
            ids = rows.ids[first:last]
            for part in _slices(len(own), n):
                at = own[part]
                scores = products(anchors.comps[at], rows.comps[first:last])
                keys = _keys(scores)
                for i, place in enumerate(at):
                    own_id = anchors.ids[place]
                    start, end = np.searchsorted(ids, [own_id, own_id + 1])
                    others = np.concatenate([keys[i, :start], keys[i, end:]])
                    for key in _best(others[None, :], wanted)[0]:
                        out.append((int(anchors.rows[place]), int(own_id), 0,
                                    int(ids[n - 1 - int(key) % int(n)]), str(int(key) // int(n))))
        return _table(out, POSITIVE)

    return run


def _negatives(scale: float, wanted: int, least: int, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], NEGATIVE)
        anchors, rows = (_Block(t, scale, by_label=False) for t in (left, right))
        positives = left["positives"].to_pylist()
        unlike = {label: rows.labels != label for label in np.unique(anchors.labels)}
        out, n = [], len(rows)
        for part in _slices(len(anchors), n):
            scores = products(anchors.comps[part], rows.comps)
            keys = _keys(scores)
            for i, place in enumerate(range(part.start, part.stop)):
                others = np.sort(keys[i, unlike[anchors.labels[place]]])
                for p in positives[anchors.order[place]]:
                    score = int(p["score"])
                    low, high = -(-least * score // 100), most * score // 100
                    if high < low:
                        continue
                    end = np.searchsorted(others, (high + 1) * n)
                    for key in others[max(0, end - wanted):end][::-1]:
                        at, own = divmod(int(key), n)
                        if at < low:
                            break
                        out.append((int(anchors.rows[place]), int(anchors.ids[place]), p["place"],
                                    p["positive_id"], p["score"], int(rows.ids[n - 1 - own]),
                                    str(at)))
        return _table(out, NEGATIVE)

    return run


def _by_score(score: Column) -> list[Column]:
    """Descending order of whole numbers of any size written as text."""
    negative = F.startswith(score, F.lit("-"))
    digits = F.length(score)
    return [negative.asc(), F.when(negative, digits).otherwise(-digits).asc(),
            F.when(negative, score).asc(), F.when(~negative, score).desc()]


def mine(
    vectors: DataFrame, label: str = "label", vector: str = "embedding", row_id: str = "vec_id",
    scale: float = 256.0, every: int = 50, positives: int = 5, negatives: int = 3,
    least: int = 50, most: int = 95, anchors: int = ANCHORS, candidates: int = CANDIDATES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score lies between ``least`` and ``most`` hundredths of its positive's.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    # A number per row, written down, deals rows to blocks: ids may come any number of times.
    rows = settled(
        vectors.filter(F.col(label).isNotNull() & F.col(row_id).isNotNull() & finite)
        .select(F.monotonically_increasing_id().alias("row"),
                F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                F.col(vector).alias("vector")))
    is_anchor = F.col("id") % every == 0
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    across = max(1, -(-n_anchors // anchors))
    cores = spark.sparkContext.defaultParallelism
    down = max(1, -(-n_rows // candidates), min(n_rows // LEAST_CANDIDATES, 2 * cores))

    def dealt(blocks: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")

    def meeting(own: DataFrame, fn, schema: str) -> DataFrame:
        """Every block of anchors with every block of rows."""
        left = own.withColumns({
            "a": dealt(across), "c": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
        # Columns of the same table on both sides would be taken for one side's only.
        right = rows.select(*[F.col(c).alias(c) for c in rows.columns]).withColumns({
            "c": dealt(down), "a": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
        return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(fn, schema)

    own = rows.filter(is_anchor)
    found = meeting(own, _positives(scale, positives), POSITIVE)
    by_anchor = Window.partitionBy("anchor").orderBy(*_by_score(F.col("score")), "positive_id")
    best = found.withColumn("place", F.row_number().over(by_anchor).cast("long")).filter(
        F.col("place") <= positives)
    asked = best.groupBy(F.col("anchor").alias("row")).agg(
        F.collect_list(F.struct("place", "positive_id", "score")).alias("positives"))
    asked = settled(own.join(asked, "row"))
    met = meeting(asked, _negatives(scale, negatives, least, most), NEGATIVE)
    by_positive = Window.partitionBy("anchor", "place").orderBy(
        *_by_score(F.col("score")), "negative_id")
    return (
        met.withColumn("rank", F.row_number().over(by_positive))
        .filter(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id",
                _clamped("positive_score"), _clamped("score").alias("negative_score"))
    )


def _clamped(score: str) -> Column:
    """A whole number written as text as the nearest 64-bit one."""
    text = F.col(score)
    edge = F.when(F.startswith(text, F.lit("-")), F.lit(_LEAST)).otherwise(F.lit(_MOST))
    return F.coalesce(text.try_cast("bigint"), edge).alias(score)
