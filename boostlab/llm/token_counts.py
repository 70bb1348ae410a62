"""Token counts of whole texts, huge ones in overlapping chunks.

A text of more than ``chunk`` characters is cut into chunks that overlap. Chunks are dealt
to tasks one by one and encoded with offsets. Neighbours are spliced at a boundary between
pre-tokens that both have inside their overlap. Such a boundary is proven stable when it
ends before the last ``GUARD`` characters of the left chunk: the splitting pattern looks
ahead by less than that, no special string is longer, and it never looks back, so what
follows a true boundary is split alike wherever the chunk began. Where two neighbours have
no stable boundary in common, the document is encoded again with overlaps twice as wide
(and chunks to match), until one chunk holds it.

Texts within one chunk are encoded whole. If all their characters are of blocks on which
both libraries' patterns agree, the byte-pair ranks of the same vocabulary count them
(some four times faster); any other text goes to the tokenizer of the ``.json`` file.

Defined results: a null text is empty, with 0 tokens; a repeated row repeats its result; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boostlab.llm.common import empty_if_null, settled

CHUNK, OVERLAP = 65_536, 2_048
#: Characters at the end of a chunk in which a boundary may still move: the longest special
#: string has 13, the pattern's contractions and white-space rule see 3.
GUARD = 16
#: Characters on whose classes the two libraries cannot differ.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")
#: Longer runs of one class are left to the tokenizer of the ``.json`` file.
_LONG_RUN = re.compile(r"\s{2000}|[^\s]{2000}")
_made: dict = {}


def _tokenizer(path: str, offsets: bool):
    """One tokenizer per Python worker. With offsets, these cover each token's white space."""
    if (path, offsets) not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        made = Tokenizer.from_file(path)
        if offsets:
            made.post_processor = processors.ByteLevel(trim_offsets=False)
        _made[path, offsets] = made
    return _made[path, offsets]


def _ranks(path: str):
    """The same vocabulary as byte-pair ranks, special strings handled as by default."""
    if path not in _made:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _made[path] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
            special_tokens={"<|endoftext|>": len(ranks)},
        )
    return _made[path]


def _count_whole(texts: list[str], path: str, ranks: str | None) -> list[int]:
    counts, rest = [0] * len(texts), []
    for i, text in enumerate(texts):
        if ranks is None or _PLAIN.search(text) or _LONG_RUN.search(text):
            rest.append(i)
        else:
            counts[i] = len(_ranks(ranks).encode(text, allowed_special="all"))
    for i in rest:
        counts[i] = len(_tokenizer(path, False).encode(texts[i], add_special_tokens=False).ids)
    return counts


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Give each row a key of its own, the same in every attempt of the task."""
    import xxhash

    seen: dict[str, int] = {}
    part = TaskContext.get().partitionId()
    for frame in frames:
        keys = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            own = f"{doc_id}:{xxhash.xxh3_64_hexdigest(text.encode('utf-8'))}:{part}"
            seen[own] = seen.get(own, -1) + 1
            keys.append(f"{own}:{seen[own]}")
        yield frame.assign(doc_id=frame["doc_id"].astype("Int64"), key=keys)


def _chunks(chunk: int, overlap: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame["key"], frame["text"]):
                starts = list(range(0, max(1, len(text) - overlap), chunk))
                yield pd.DataFrame({
                    "key": key, "number": range(len(starts)), "last": len(starts) - 1,
                    "start": starts,
                    "text": [text[at:at + chunk + overlap] for at in starts],
                })

    return cut


_CHUNK_SCHEMA = "key string, number int, last int, start long, text string"
_EDGE = "array<struct<place: long, tokens: long>>"


def _encode(path: str, overlap: int):
    """Per chunk its tokens and, in either overlap, the boundaries between pre-tokens with
    the tokens before them."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lefts, rights, counts = [], [], []
            for number, last, start, text in zip(
                frame["number"], frame["last"], frame["start"], frame["text"]
            ):
                made = _tokenizer(path, True).encode(text, add_special_tokens=False)
                offsets, words = made.offsets, made.word_ids
                edges = [
                    (start + offsets[i][0], i) for i in range(1, len(words))
                    if words[i] != words[i - 1] or words[i] is None
                ]
                end = start + len(text)
                lefts.append([{"place": p, "tokens": i} for p, i in edges
                              if number > 0 and p <= start + overlap])
                rights.append([{"place": p, "tokens": i} for p, i in edges
                               if number < last and end - overlap <= p <= end - GUARD])
                counts.append(len(words))
            yield pd.DataFrame({
                "key": frame["key"], "number": frame["number"], "last": frame["last"],
                "n_tokens": counts,
                "left_edges": lefts, "right_edges": rights,
            })

    return encode


def _splice(encoded: DataFrame) -> DataFrame:
    """Per document: its tokens, or null if some pair of neighbours has no common boundary."""
    order = Window.partitionBy("key").orderBy("number")
    after = encoded.withColumn("next_edges", F.lead("left_edges").over(order))
    common = F.get(F.array_intersect(F.col("right_edges.place"), F.col("next_edges.place")), 0)
    met = after.withColumn("place", common).withColumn(
        "cut", F.get(F.filter("right_edges", lambda r: r["place"] == F.col("place")), 0))
    entered = F.lag("cut").over(order)["place"]
    own = F.coalesce(F.col("cut")["tokens"],
                     F.when(F.col("number") == F.col("last"), F.col("n_tokens")))
    before = F.try_element_at(
        F.filter("left_edges", lambda n: n["place"] == F.col("entered")), F.lit(1)
    )["tokens"]
    parts = (
        met.withColumn("entered", entered).withColumn(
            "part",
            own - F.when(F.col("number") == 0, F.lit(0)).otherwise(before),
        )
    )
    return parts.groupBy("key").agg(
        F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens")
    )


def _count_long(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Counts of keyed texts, by key."""
    parallel = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, pending = [], texts.select("key", "text")
    while True:
        pieces = pending.mapInPandas(_chunks(chunk, overlap), _CHUNK_SCHEMA)
        encoded = pieces.repartition(parallel, "key", "number").mapInPandas(
            _encode(path, overlap),
            "key string, number int, last int, n_tokens long, "
            f"left_edges {_EDGE}, right_edges {_EDGE}",
        )
        counted = settled(_splice(encoded))
        done.append(counted.filter("n_tokens is not null"))
        failed = counted.filter("n_tokens is null").select("key")
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        pending = texts.join(failed, "key", "left_semi").select("key", "text")
        overlap, chunk = 2 * overlap, max(chunk, 4 * overlap)


def count_tokens(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, text: str = "text",
    doc_id: str = "doc_id", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``), chunked.

    ``tokenizer`` is the ``.json`` file, ``ranks`` the same vocabulary as ranks; both paths
    must exist on every executor. ``chunk`` is at least twice the overlap.
    """
    if chunk < 2 * overlap or overlap <= GUARD:
        raise ValueError("a chunk holds two overlaps, an overlap more than the guard")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text)).alias("text")
    )
    is_long = F.length("text") > chunk + overlap

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"), "n_bytes": frame["n_bytes"],
                "n_tokens": _count_whole(list(frame["text"]), tokenizer, ranks),
            })

    counted = "doc_id long, n_bytes long, n_tokens long"
    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = sized.filter(~is_long).mapInPandas(whole, counted)
    texts = settled(
        sized.filter(is_long).mapInPandas(
            _keyed, "doc_id long, text string, n_bytes long, key string")
    )
    long_counts = _count_long(texts, tokenizer, chunk, overlap)
    spliced = texts.select("key", "doc_id", "n_bytes").join(long_counts, "key")
    return (
        short.withColumn("chunked", F.lit(False))
        .unionByName(spliced.select("doc_id", "n_bytes", "n_tokens",
                                    F.lit(True).alias("chunked")))
        .select("doc_id", "n_bytes", "n_tokens",
                (F.col("n_tokens") > limit).alias("over_limit"), "chunked")
    )
