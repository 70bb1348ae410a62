"""Near duplicates: minima of universal hashes, bands, verification, star components.

1. A document's set are its distinct shingles of five words as 64-bit hashes. Documents of
   equal sets collapse into one class, represented by the smallest id (by a written row
   number if an id comes with several rows). ``HASHES`` minima of multiply-shift hashes make
   up the signature of a class.
2. Signatures are cut into ``BANDS`` bands. Classes that agree in a band share a bucket. A
   pair at the least similarity of 0.75 shares none with a probability of 5e-6.
3. Every class is paired with the smallest class of each of its buckets, so a bucket of m
   classes gives m - 1 pairs. Pairs whose signatures cannot belong to a link (64 of 128
   minima differ: 6 standard deviations) are left out, all others are confirmed on the full
   sets, and components are found over the links.
4. Buckets that hold classes of several components are finished exactly. A link needs a
   common shingle among the first size - ceil(0.75 * size) + 1 of either set, in any fixed
   order; the rarest come first. Classes connected through such shingles are a family, dealt
   in blocks of bounded size. A task counts the shingles that the members of two blocks have
   in common, from lists of members by shingle over their full sets (signatures have no say
   here), and hands over links alone, at most one per merged component. So no link between
   components is lost, and no bucket or family emits its pairs.
5. Components: large-star and small-star alternate until every node has either one smaller
   neighbour or only larger ones. Links of the fourth step name components, so they are
   merged among themselves, without the links before.

Links within a component that follow from others are not confirmed, as they change nothing.

Defined results: a null or empty text, or one without words, has an empty set, is linked
with nothing and stays; fewer than five words are one shingle; a null ``doc_id`` is linked
with nothing, has a null component and stays; a repeated row repeats its result; an id with
different texts has one result per text, of the component of that text (which is named by its
smallest id); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlab.llm.common import empty_if_null, lowered_bytes, settled

WORDS, PERCENT = 5, 75
HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
#: Least equal minima of a pair that is confirmed on full sets.
LEAST_EQUAL = 64
#: Members of one class compared in one task before the class is dealt to more tasks.
STAR_ROWS = 256
#: A shingle of more than one in so many, and of at least so many classes, is counted back
#: in several tasks; at most ``HOT_SHINGLES`` shingles are, which bounds the table of them.
HOT_SHINGLES, LEAST_HOT = 2000, 64
#: Shingles of one family held in one block; a task compares two blocks at most.
BLOCK_SHINGLES = 500_000
#: Ids that may be broadcast to pick out the texts of a few documents.
BROADCAST_IDS = 200_000
REMEMBERED = 500_000

_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_word_hashes: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    import xxhash

    words = lowered_bytes(text).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _word_hashes
    fresh = {w for w in words if w not in known}
    if fresh:
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = set(words)
        for w in fresh:
            known[w] = xxhash.xxh3_64_intdigest(w)
    ids = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(ids))
    made = np.full(len(ids) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        made += _mixed(ids[j:len(ids) - size + 1 + j] + _PLACE[j]) * _PLACE[j]
    return np.unique(_mixed(made))


def signature(found: np.ndarray) -> bytes:
    """Upper halves of the minima, 4 bytes each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):
        block = found[at:at + 512, None] * _A[None, :]
        block += _B[None, :]
        np.minimum(least, block.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for frame in frames:
        sizes, keys, minima = [], [], []
        for text in frame["text"]:
            found = shingles(text)
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            minima.append(signature(found) if len(found) else None)
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"),
                            "row": frame["row"].astype("Int64"), "n": sizes,
                            "set_key": keys, "minima": minima})


def _banded(classes: DataFrame, *names: str) -> DataFrame:
    """One row per class and band: bucket, rep and the columns named."""
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring(
            F.col("minima"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    return classes.select("rep", *names, F.explode(bands).alias("bucket"))


def _may_link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose signatures and sizes allow a link."""
    for frame in frames:
        if len(frame):
            a = np.frombuffer(b"".join(frame["minima_a"]), dtype="<u4").reshape(-1, HASHES)
            b = np.frombuffer(b"".join(frame["minima_b"]), dtype="<u4").reshape(-1, HASHES)
            small, large = (frame[["n_a", "n_b"]].agg(k, axis=1).to_numpy()
                            for k in ("min", "max"))
            keep = ((a == b).sum(axis=1) >= LEAST_EQUAL) & (100 * small >= PERCENT * large)
            frame = frame[keep]
        yield frame[["a", "b"]]


def _side(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("rep").alias(name), F.col("minima").alias(f"minima_{name}"),
                          F.col("n").alias(f"n_{name}"))


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    both = pairs.join(_side(classes, "a"), "a").join(_side(classes, "b"), "b")
    return both.mapInPandas(_may_link, "a long, b long")


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """One text for each of the ids (column ``id``)."""
    n = ids.count()
    wanted = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi").select(
        F.col("doc_id").alias("id"), "text")


def _confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted so that a class comes before the members it is compared with."""
    hub, held = None, None
    for frame in frames:
        a, b = [], []
        for own, member, text in zip(frame["a"], frame["b"], frame["text"]):
            found = shingles(text)
            if own == member:
                hub, held = own, found
            elif own == hub:
                common = len(np.intersect1d(held, found, assume_unique=True))
                if 100 * common >= PERCENT * (len(held) + len(found) - common):
                    a.append(own)
                    b.append(member)
        yield pd.DataFrame({"a": pd.array(a, "int64"), "b": pd.array(b, "int64")})


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a < b, distinct) that are links, confirmed on full sets.

    Members meet their class in one task per ``STAR_ROWS`` members, in which one set and one
    member are held at a time.
    """
    pairs = settled(pairs)
    ids = settled(
        pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = _texts_of(ids, docs)
    shares = pairs.groupBy("a").agg(
        F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("shares"))
    members = pairs.join(shares, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    heads = shares.select(
        "a", F.col("a").alias("b"),
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    rows = members.unionByName(heads).join(texts, F.col("b") == texts["id"])
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("a", "share", "b", "text").repartition(
        parallel, "a", "share").sortWithinPartitions("a", "share", "b")
    return settled(dealt.mapInPandas(_confirm, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """rep, component (the smallest id reached) of all ends of ``edges`` (a, b), which are read
    several times.

    Large-star links every larger neighbour of a node with the node's smallest, small-star
    its smaller ones and itself. Once all that have a smaller neighbour have no other, every
    component is a star around its smallest node. The nodes, and the links if another round
    is needed, are written; links never become more.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(
        "u <> v")
    while True:
        nodes = settled(now.union(now.select("v", "u")).groupBy("u").agg(
            F.min("v").alias("least"), F.max("v").alias("most"),
            F.max(F.expr("if(v < u, v, null)")).alias("below")))
        if nodes.filter("least < u and (below > least or most > u)").isEmpty():
            return nodes.select(
                F.col("u").alias("rep"), F.least("u", "least").alias("component"))
        low = nodes.select(F.col("u").alias("v"), F.least("u", "least").alias("m"))
        large = now.join(low, "v").select("u", F.col("m").alias("v"))
        order = Window.partitionBy("u").orderBy("v")
        small = large.select(
            "u", "v", F.min("v").over(order).alias("m"), F.lag("v").over(order).alias("before")
        ).filter("before is null or before < v")
        now = settled(small.select(
            F.expr("if(v = m, u, v)").alias("u"), F.col("m").alias("v")))


def _first_pairs(classes: DataFrame) -> DataFrame:
    """Every class with the smallest of each of its buckets."""
    rows = _banded(classes)
    hubs = rows.groupBy("bucket").agg(
        F.min("rep").alias("a"), F.max("rep").alias("top")).filter("a < top").select("bucket", "a")
    return rows.join(hubs, "bucket").filter("a < rep").select(
        "a", F.col("rep").alias("b")).distinct()


def _set_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), 256):
            part = frame.iloc[at:at + 256]
            yield pd.DataFrame({
                "rep": part["id"],
                "held": [shingles(text).view(np.int64).tolist() for text in part["text"]]})


def _compare_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components that a link joins within a family; rows come sorted by (family, i, j).

    Found links merge their components at once, so pairs they connect are skipped.
    """
    names = ["family", "i", "j"]
    held, key = [], None
    for frame in frames:
        for own, part in frame.groupby(names, sort=False):
            if own != key and held:
                yield _block_links(pd.concat(held), key)
                held = []
            held.append(part)
            key = own
    if held:
        yield _block_links(pd.concat(held), key)


def _block_links(rows: pd.DataFrame, key: tuple) -> pd.DataFrame:
    across = key[1] != key[2]
    reps, sizes = rows["rep"].to_numpy(), rows["n"].to_numpy()
    component, block = rows["component"].to_numpy(), rows["block"].to_numpy()
    label = component.copy()
    sets = [np.asarray(s, dtype=np.int64) for s in rows["held"]]
    lengths = np.array([len(s) for s in sets])
    # Rows by shingle: those of the k-th one are holders[starts[k]:starts[k] + times[k]].
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), lengths)[np.argsort(number, kind="stable")]
    times = np.bincount(number)
    starts = np.cumsum(times) - times
    ends = np.cumsum(lengths)
    a, b = [], []
    for x in range(len(reps) - 1):
        after = np.arange(x + 1, len(reps))
        after = after[(label[after] != label[x])
                      & (100 * np.minimum(sizes[after], sizes[x])
                         >= PERCENT * np.maximum(sizes[after], sizes[x]))]
        if across:
            after = after[block[after] != block[x]]
        if not len(after):
            continue
        own = number[ends[x] - lengths[x]:ends[x]]
        shared = np.zeros(len(reps), dtype=np.int64)
        for at in range(0, len(own), 256):  # the rows of some shingles at a time
            first, count = starts[own[at:at + 256]], times[own[at:at + 256]]
            places = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared += np.bincount(holders[places], minlength=len(reps))
        common = shared[after]
        linked = after[100 * common >= PERCENT * (len(own) + sizes[after] - common)]
        for y in linked.tolist():
            if label[y] != label[x]:
                a.append(component[x])
                b.append(component[y])
                label[label == label[y]] = label[x]
    return pd.DataFrame({"a": pd.array(a, "int64"), "b": pd.array(b, "int64")})


def _counted_back(each: DataFrame) -> DataFrame:
    """rep, shingle, times: how many classes have each shingle, of those with several. Rows
    of frequent shingles are dealt to lots."""
    often = settled(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter(
        "times > 1"))
    total = often.agg(F.sum("times")).first()[0] or 0
    share = max(LEAST_HOT, total // HOT_SHINGLES)
    sized = often.withColumn("lots", F.ceil(F.col("times") / share).cast("int"))
    hot = F.broadcast(sized.filter("lots > 1").select("shingle", "lots"))
    dealt = each.join(hot, "shingle", "left").select(
        "rep", "shingle",
        F.coalesce(F.pmod(F.xxhash64("rep"), F.col("lots")), F.lit(0)).cast("int").alias("lot"))
    answers = sized.withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    return dealt.join(answers, ["shingle", "lot"]).drop("lot")


def _rest_links(placed: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Pairs of components that a link joins, of those that share a bucket, found through rare
    shingles."""
    rows = _banded(placed, "component")
    mixed = rows.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_ids = settled(
        rows.join(mixed.select("bucket"), "bucket").select(F.col("rep").alias("id")).distinct())
    if open_ids.isEmpty():
        return None
    held = settled(_texts_of(open_ids, docs).mapInPandas(
        _set_rows, "rep long, held array<long>"))
    each = held.select("rep", F.explode("held").alias("shingle"))
    # The rarest shingles come first; those of one class alone join nothing and come before.
    common = _counted_back(each).groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("times", "shingle")))["shingle"].alias("common"))
    length = F.size("common") - F.ceil(F.col("n") * PERCENT / 100) + 1
    keys = settled(
        common.join(placed.select("rep", "n", "component"), "rep").select(
            "rep", "component", F.explode(F.slice(
                "common", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("shingle")))
    stars = keys.groupBy("shingle").agg(
        F.min("rep").alias("a"), F.min("component").alias("low"),
        F.max("component").alias("high")).filter("low < high").select("shingle", "a")
    joint = settled(keys.join(stars, "shingle").select(
        "a", F.col("rep").alias("b")).distinct())
    if joint.isEmpty():
        return None
    families = components(joint).withColumnRenamed("component", "family")
    members = placed.join(families, "rep").join(held, "rep")
    blocks = members.groupBy("family").agg(
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    numbered = members.join(blocks, "family").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = numbered.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select("family", F.least("block", "other").alias("i"),
             F.greatest("block", "other").alias("j"),
             "block", "rep", "n", "component", "held")
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(parallel, "family", "i", "j").sortWithinPartitions(
        "family", "i", "j")
    return settled(dealt.mapInPandas(_compare_blocks, "a long, b long"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(F.col(text)).alias("text"))
    several = _repeats(rows)
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id())) if several else (
        rows.withColumn("row", F.col("doc_id")))
    sets = settled(rows.mapInPandas(
        _sets, "doc_id long, row long, n long, set_key binary, minima binary"))
    classes = settled(
        sets.filter("set_key is not null and doc_id is not null")
        .groupBy("set_key", "n", "minima").agg(
            F.min("row").alias("rep"), F.min("doc_id").alias("least_id")))
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    edges = _links(_plausible(_first_pairs(classes), classes), texts)
    placed = settled(classes.join(components(edges), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")))
    more = _rest_links(placed, texts)
    placed = placed.select("set_key", "least_id", F.col("component").alias("component_id"))
    if more is not None and not more.isEmpty():
        top = components(more)
        placed = placed.join(top, placed["component_id"] == top["rep"], "left").select(
            "set_key", "least_id", F.coalesce("component", "component_id").alias("component_id"))
    if several:  # row numbers are not in the order of ids
        ids = placed.groupBy("component_id").agg(F.min("least_id").alias("id"))
        placed = placed.join(ids, "component_id").select(
            "set_key", F.col("id").alias("component_id"))
    placed = placed.select("set_key", "component_id")
    return sets.join(placed, "set_key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), _component("component_id"),
        (_own("component_id") == F.col("doc_id")).alias("kept"),
    ).withColumn("kept", F.coalesce("kept", F.lit(True)))


def _own(component: str) -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col(component), F.col("doc_id")))


def _component(component: str) -> Column:
    return _own(component).alias("component_id")


def _repeats(rows: DataFrame) -> bool:
    """Whether some id comes with several rows."""
    return not rows.groupBy("doc_id").count().filter(
        "count > 1 and doc_id is not null").isEmpty()
