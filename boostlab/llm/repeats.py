"""Removal of long repeated strings, found by common-prefix intervals of suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes. The
suffixes of all documents are dealt to tasks so that equal strings of ``length`` bytes meet:

1. Windows. Each start of a ``length``-byte window is assigned the place of the least hash
   among the ``GRAM``-byte strings inside the window (its anchor). Equal windows have equal
   anchors, and neighbouring windows mostly share one, so a document becomes a list of
   segments: runs of windows with one anchor. A segment is known by two independent 64-bit
   hashes, of its anchor and of all its bytes.
2. Segments with equal bytes are one string with several occurrences: all of it is repeated.
   Only anchors with two or more different strings need the suffix array; just for these
   the bytes of one occurrence per string are fetched.
3. Suffix array. A task concatenates the strings of whole anchors, sorts the suffixes that
   start a window, takes the common prefixes of neighbours and scans them with a stack:
   every popped interval with a prefix of at least ``length`` bytes is a repeat with all its
   occurrences. It is kept if its left extensions differ (or one of them is the start of a
   string), as otherwise the interval one byte earlier holds the same bytes and more.
4. The covered ranges of a string are those of all documents that hold it; ranges are merged
   per document and cut from its bytes.

Anchors with more than ``HOT`` different strings are split first, not dealt to one task:
windows are told apart by their distance to the anchor, in ranges that halve from step to
step, and by a hash of the bytes which all windows of a range have in common. Strings that
shared a short common passage part in the first steps; a last step of single windows is
counted without any grouping in memory.

Memory of a task: one batch of documents, or about ``SHARD_BYTES`` of strings.

Defined results: a null text is empty, nothing is removed from it and its digest is that of
no bytes; matches never cross documents; a repeated row is a document of its own, so its
text of at least ``length`` bytes goes from both; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlab.llm.common import empty_if_null, numbered, settled

LENGTH, GRAM = 400, 64
#: Different strings of one anchor beyond which its windows are split.
HOT = 2_000
SHARD_BYTES = 1_000_000
#: Longest stretch of one document worked on at a time.
STRETCH = 4_000_000
#: Segments handed over at a time.
FLUSH_ROWS = 100_000
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ..., n - 1 modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A mixed rolling hash of every string of ``gram`` bytes."""
    n = len(raw)
    if len(_tables.get("up", ())) < n + 1:
        size = max(n + 1, 1 << 16)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _tables["down"][:n], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * _tables["up"][:n - gram + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by blocks: the least up to the end of a block
    and the least from the start of the next one meet."""
    n = len(keys)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def segments_of(raw: bytes, length: int, gram: int) -> Iterator[tuple]:
    """Arrays (anchor hash, start, windows, pivot) of a document's segments; ``pivot`` is the
    distance from the segment's first window to the anchor."""
    for at in range(0, max(0, len(raw) - length + 1), STRETCH):
        part = np.frombuffer(raw, dtype=np.uint8)[at:at + STRETCH + length - 1]
        hashes = _gram_hashes(part, gram)
        width = length - gram + 1
        places = np.arange(len(hashes), dtype=np.uint64)
        keys = (hashes & ~np.uint64(0xFFFFFF)) | places  # the first of equal hashes
        anchor = (_window_least(keys, width) & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        ends = np.append(starts[1:], len(anchor))
        chosen = anchor[starts]
        yield hashes[chosen].view(np.int64), starts + at, ends - starts, chosen - starts


def _segment_rows(length: int, gram: int):
    """Rows of segments per document. A string that comes again in the same document is one
    row with all its starts."""

    def document(raw: bytes, digest) -> tuple:
        view = memoryview(raw)
        parts = list(segments_of(raw, length, gram))
        anchors, starts, windows, pivots = (np.concatenate(c) for c in zip(*parts))
        ends = starts + windows + (length - 1)
        strings = np.array([digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist())],
                           dtype=np.uint64).view(np.int64)
        _, first, group, held = np.unique(
            strings, return_index=True, return_inverse=True, return_counts=True)
        return (anchors[first], strings[first], held, starts[np.argsort(group, kind="stable")],
                windows[first], pivots[first])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def flush() -> pa.RecordBatch:
            anchors, strings, held, starts, windows, pivots = (
                np.concatenate(c) for c in zip(*made))
            bounds = np.concatenate(([0], np.cumsum(held)))
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(rows, sizes), pa.int64()), pa.array(anchors),
                pa.array(strings),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(starts)),
                pa.array(windows, pa.int32()), pa.array(pivots, pa.int32())],
                names=["row", "anchor", "string", "starts", "windows", "pivot"])

        made, rows, sizes, size = [], [], [], 0
        for batch in batches:
            for own, raw in zip(batch["row"].to_pylist(), batch["raw"]):
                raw = raw.as_py()
                if len(raw) < length:
                    continue
                made.append(document(raw, xxhash.xxh3_64_intdigest))
                rows.append(own)
                sizes.append(len(made[-1][0]))
                size += sizes[-1]
                if size >= FLUSH_ROWS:
                    yield flush()
                    made, rows, sizes, size = [], [], [], 0
        if made:
            yield flush()

    return cut


_SEGMENTS = ("row long, anchor long, string long, starts array<long>, windows int, pivot int")


def _fetch(length: int):
    """The bytes of the wanted strings of each document."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                part = frame.iloc[at:at + 64]
                yield pd.DataFrame([
                    (w["anchor"], w["string"], 0, w["pivot"],
                     raw[w["start"]:w["start"] + w["windows"] + length - 1])
                    for raw, wanted in zip(part["raw"], part["wanted"]) for w in wanted
                ], columns=["anchor", "string", "shift", "pivot", "raw"])

    return cut


_STRINGS = "anchor long, string long, shift int, pivot int, raw binary"


def suffix_array(texts: list[bytes], length: int):
    """Suffixes that start a window of ``length`` bytes, in order, as (text, place) arrays,
    with the common prefix of each and the one before it (0 for the first; whole lengths
    where it reaches ``length``, else any smaller number)."""
    joined = b"".join(texts)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    which = np.concatenate([np.full(len(t) - length + 1, i) for i, t in enumerate(texts)])
    start = np.concatenate([np.arange(b, b + len(t) - length + 1)
                            for b, t in zip(bounds, texts)])
    end = bounds[which + 1]
    suffixes = [joined[a:b] for a, b in zip(start.tolist(), end.tolist())]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), dtype=np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(
        np.frombuffer(joined, dtype=np.uint8), length)
    common = np.zeros(len(order), dtype=np.int64)
    for at in range(1, len(order), 8192):
        now = order[at:at + 8192]
        before = order[at - 1:at - 1 + len(now)]
        same = (rows[start[now]] == rows[start[before]]).all(axis=1)
        common[at:at + len(now)] = np.where(same, length, 0)
    for i in np.flatnonzero(common).tolist():
        one, two = suffixes[order[i]], suffixes[order[i - 1]]
        size, most = length, min(len(one), len(two))
        while size < most and one[size:size + 32] == two[size:size + 32]:
            size = min(size + 32, most)
        while size < most and one[size] == two[size]:
            size += 1
        common[i] = size
    return which[order], (start - bounds[which])[order], common


def repeat_groups(texts: list[bytes], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of at least ``length`` bytes: (bytes, occurrences as (text, place)).

    A stack of open common-prefix intervals is scanned over the suffix array. An interval
    that ends is left-maximal if the bytes before its occurrences differ or one of them
    begins its text.
    """
    which, place, common = suffix_array(texts, length)
    before = [texts[w][p - 1] if p else -1 for w, p in zip(which.tolist(), place.tolist())]
    stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
    for i, size in enumerate([*common[1:].tolist(), 0] if len(common) else []):
        first = i
        while stack and stack[-1][0] > size:
            depth, first = stack.pop()
            extensions = set(before[first:i + 1])
            if len(extensions) > 1 or -1 in extensions:
                yield depth, list(zip(which[first:i + 1].tolist(), place[first:i + 1].tolist()))
        if size >= length and (not stack or stack[-1][0] < size):
            stack.append((size, first))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            if last > out[-1][1]:
                out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def _scan_shards(length: int):
    """Covered ranges of strings; rows come sorted by bucket, shards hold whole buckets."""

    def work(held: list[tuple]) -> pd.DataFrame:
        ranges: dict[int, list[tuple[int, int]]] = {}
        for size, places in repeat_groups([h[3] for h in held], length):
            for which, place in places:
                ranges.setdefault(which, []).append((place, place + size))
        rows = [(held[w][0], held[w][1], held[w][2] + a, held[w][2] + b)
                for w, found in ranges.items() for a, b in _merged(found)]
        return pd.DataFrame(rows, columns=["anchor", "string", "first", "last"])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, bucket = 0, None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.bucket != bucket and size >= SHARD_BYTES:
                    yield work(held)
                    held, size = [], 0
                bucket = row.bucket
                held.append((row.anchor, row.string, row.shift, row.raw))
                size += len(row.raw)
        if held:
            yield work(held)

    return scan


def _halved(length: int, gram: int, span: int):
    """Strings cut where the distance of a window to the anchor enters another range of
    ``span`` distances; the new bucket is a hash of what all windows of the range share."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                windows = len(row.raw) - length + 1
                at = 0
                while at < windows:
                    distance = row.pivot - at
                    low = distance // span * span
                    upto = min(windows, at + distance - low + 1)
                    high = min(low + span - 1, length - gram)
                    # windows at distances low..high share these bytes around the anchor
                    first, last = row.pivot - low, row.pivot - high + length
                    key = xxhash.xxh3_64_intdigest(row.raw[max(first, 0):last], low) \
                        ^ (row.anchor & (2**64 - 1))
                    rows.append((
                        key - 2**63, row.anchor, row.string,
                        row.shift + at, row.pivot - at, row.raw[at:upto + length - 1]))
                    at = upto
            yield pd.DataFrame(rows, columns=["bucket", "anchor", "string", "shift", "pivot",
                                              "raw"])

    return cut


def _ranges(strings: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """Covered ranges (anchor, string, first, last) of the strings of mixed anchors."""
    parallel = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    live = settled(strings.withColumn("bucket", F.col("anchor")))
    span, parts = 1 << (length - gram).bit_length(), []
    while True:
        sizes = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
        small = live.join(sizes.filter(f"held between 2 and {hot}").select("bucket"), "bucket")
        parts.append(settled(
            small.select("bucket", "anchor", "string", "shift", "raw")
            .repartition(4 * parallel, "bucket").sortWithinPartitions("bucket")
            .mapInPandas(_scan_shards(length),
                         "anchor long, string long, first long, last long")))
        large = live.join(sizes.filter(f"held > {hot}").select("bucket"), "bucket")
        if large.isEmpty():
            break
        if span == 1:  # single windows of one hash: all of them are the same string
            parts.append(large.select(
                "anchor", "string", F.col("shift").cast("long").alias("first"),
                (F.col("shift") + length).cast("long").alias("last")))
            break
        span //= 2
        live = settled(large.select(*[c.split()[0] for c in _STRINGS.split(", ")]).mapInPandas(
            _halved(length, gram, span), f"bucket long, {_STRINGS}"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for raw, ranges in zip(frame["raw"], frame["ranges"]):
            runs = _merged([] if ranges is None else [(r["first"], r["last"]) for r in ranges])
            kept, at = hashlib.sha256(), 0
            view = memoryview(raw)
            for first, last in runs:
                kept.update(view[at:first])
                at = last
            kept.update(view[at:])
            rows.append((len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest(),
                         [{"first": a, "last": b} for a, b in runs]))
        made = pd.DataFrame(
            rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        made.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
        yield made.astype({"doc_id": "Int64"})


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed ranges
    of bytes)."""
    rows = numbered(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        empty_if_null(F.col(text)).cast("binary").alias("raw")))
    segments = settled(rows.select("row", "raw").mapInArrow(
        _segment_rows(length, gram), _SEGMENTS))
    strings = settled(
        segments.groupBy("anchor", "string").agg(
            F.sum(F.size("starts")).alias("held"),
            F.min(F.struct("row", F.element_at("starts", 1).alias("start"), "windows", "pivot"))
            .alias("at")))
    mixed = strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    wanted = strings.join(mixed.select("anchor"), "anchor").select(
        F.col("at.row").alias("row"), "anchor", "string", F.col("at.start").alias("start"),
        F.col("at.windows").alias("windows"), F.col("at.pivot").alias("pivot"))
    by_row = wanted.groupBy("row").agg(F.collect_list(
        F.struct("anchor", "string", "start", "windows", "pivot")).alias("wanted"))
    fetched = rows.join(by_row, "row").select("raw", "wanted").mapInPandas(
        _fetch(length), _STRINGS)
    partial = _ranges(fetched, length, gram, hot)
    whole = strings.filter("held > 1").select(
        "anchor", "string", F.lit(0).cast("long").alias("first"),
        (F.col("at.windows") + (length - 1)).cast("long").alias("last"))
    covered = whole.unionByName(partial)
    spans = segments.join(covered, ["anchor", "string"]).select(
        "row", F.explode("starts").alias("start"), "first", "last")
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("first")).alias("first"),
        (F.col("start") + F.col("last")).alias("last"))).alias("ranges"))
    return rows.join(per_row, "row", "left").select("doc_id", "raw", "ranges").mapInPandas(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<first: long, last: long>>")
