"""Exact duplicates by an extendible-hash index kept in shared files.

Every distinct text is one link of the index: its 64-bit hash, SHA-256, the row that
stays and the number of rows. Links are found by comparing whole texts (they are the key
of the aggregation, so equal hashes alone never merge two texts; texts that share a hash
are chained under it). The directory starts with one bucket for all hashes. It doubles
while some bucket holds more links than it may (or the hash has no more bits): an overfull
bucket splits by the next bit of the hash, the others keep their depth and are pointed to by
several slots. Ranges of hashes are owned by tasks, so a task writes the few buckets its
range meets, one after the other, into its Parquet file.

Documents look their link up in the index: the top bits of their hash are a slot of the
directory, which points to a bucket, and there the chain of their hash is gone through until
the text's digest agrees.

DataFrame operations only. Copies are counted on the map side before the shuffle, so a
text with a third of all rows arrives as one row per task. Links of many rows are dealt to
several tasks when they are looked up.

Defined results: a null text is the empty text; a null ``doc_id`` never stays unless all
ids of its group are null; a repeated row repeats its result; an empty table gives no
rows and an index without buckets; other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boostlab.llm.common import lowered, settled
from boostlab.session import run_dir

BUCKET_LINKS = 100_000
#: Bits of a hash that a directory can tell apart.
HASH_BITS = 63
#: Slots of a directory that is broadcast, some 20 bytes each; a larger one is joined.
BROADCAST_SLOTS = 1_000_000
#: A link of more than one in so many rows is looked up in several tasks. Fewer than this
#: many links can be so large, which bounds the table of them.
HOT_LINKS = 1000


def hashed(norm: Column | str) -> Column:
    return F.xxhash64(norm)


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per distinct normalised text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("norm"))
    return (
        rows.select("doc_id", "norm", hashed("norm").alias("hash"))
        .groupBy("hash", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def directory(found: DataFrame, depth: int, capacity: int) -> DataFrame:
    """Slot by slot (the top ``depth`` bits of a hash), the bucket it points to.

    A bucket is named by a leading 1 and the bits its hashes share, so its local depth is
    the length of its name less one.
    """
    slots = found.groupBy(F.shiftrightunsigned("hash", 64 - depth).alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )
    paths = slots.select(
        "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
    ).withColumn("prefix", F.expr(f"shiftright(slot, {depth} - level)"))
    overfull = (
        paths.groupBy("level", "prefix").agg(F.sum("n").alias("held"))
        .filter(F.col("held") > capacity)
    )
    split = paths.join(overfull, ["level", "prefix"]).groupBy("slot").agg(
        (F.max("level") + 1).alias("depth")
    )
    return (
        slots.select("slot").join(split, "slot", "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
        .withColumn("bucket", F.expr(
            f"shiftleft(1L, depth) + shiftright(slot, {depth} - depth)"))
    )


def _overfull(found: DataFrame, depth: int, capacity: int) -> bool:
    """Whether a slot of this depth holds more links than a bucket may."""
    held = found.groupBy(F.shiftrightunsigned("hash", 64 - depth)).count()
    return not held.filter(F.col("count") > capacity).isEmpty()


@dataclass(frozen=True)
class Index:
    """An index in the shared folder: its buckets' links, its directory and its depth.

    Columns of links: hash, text_sha256, keep_id, group_size, chain (0 for the first link of
    a hash, then 1, 2, ... for other texts of the same hash), depth, bucket. Of the
    directory: slot, depth, bucket.
    """

    links: DataFrame
    directory: DataFrame
    depth: int

    def slot(self) -> Column:
        return F.shiftrightunsigned("hash", 64 - self.depth)


def build_index(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = BUCKET_LINKS
) -> Index:
    """Write the index to the shared folder."""
    spark = docs.sparkSession
    path = run_dir(spark, "links")
    links(docs, text, doc_id).write.parquet(path)
    found = spark.read.parquet(path)
    size = found.count()
    depth = max(1, math.ceil(math.log2(max(1, size / capacity))))
    while depth < HASH_BITS and _overfull(found, depth, capacity):
        depth += 1
    slots = settled(directory(found, depth, capacity))
    pointed = found.withColumn("slot", F.shiftrightunsigned("hash", 64 - depth)).join(
        slots, "slot")
    chains = F.row_number().over(
        Window.partitionBy("hash").orderBy("keep_id", "text_sha256")
    )
    index = run_dir(spark, "index")
    schema = ("hash long, text_sha256 string, keep_id long, group_size long, chain int, "
              "depth int, bucket long")
    (
        pointed.repartitionByRange("hash").withColumn("chain", chains - 1)
        .select(*[c.split()[0] for c in schema.split(", ")])
        .sortWithinPartitions("bucket", "hash", "chain").write.parquet(index)
    )
    return Index(spark.read.schema(schema).parquet(index), slots, depth)


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
           capacity: int = BUCKET_LINKS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return look_up(docs, build_index(docs, text, doc_id, capacity), text, doc_id)


def look_up(docs: DataFrame, index: Index, text: str = "text",
            doc_id: str = "doc_id") -> DataFrame:
    """:func:`dedupe` for documents whose texts are all in an index."""
    rows = index.links.agg(F.sum("group_size")).first()[0] or 0
    share = max(1, rows // HOT_LINKS)
    found = index.links.select(
        "bucket", "hash", F.col("text_sha256").alias("held"), "keep_id", "group_size",
        F.ceil(F.col("group_size") / share).cast("int").alias("lots"))
    # Fewer than HOT_LINKS rows, as each stands for more than a share of all rows. (Texts of
    # one hash share their lots.)
    hot = F.broadcast(found.filter("lots > 1").groupBy("bucket", "hash").agg(
        F.max("lots").alias("lots")))
    norm = lowered(F.col(text))
    probes = docs.select(
        F.col(doc_id).alias("doc_id"), hashed(norm).alias("hash"),
        F.sha2(norm, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("slot", index.slot())
    slots = index.directory.select("slot", "bucket")
    if index.directory.count() <= BROADCAST_SLOTS:
        slots = F.broadcast(slots)
    dealt = probes.join(slots, "slot").join(hot, ["bucket", "hash"], "left").select(
        "doc_id", "bucket", "hash", "text_sha256",
        F.coalesce(F.pmod("row", "lots"), F.lit(0)).cast("int").alias("lot"))
    # A chain goes to all the lots of its hash.
    chained = found.drop("lots").join(hot, ["bucket", "hash"], "left").withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
    return (
        dealt.join(chained, ["bucket", "hash", "lot"])
        .filter(F.col("held") == F.col("text_sha256"))  # along the chain
        .select("doc_id", "keep_id", "group_size",
                F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
