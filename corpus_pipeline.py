"""Documents to training sequences: toxic rows out, exact and near copies down to one,
benchmark passages out, the rest packed. Each stage's rows are written and read again by
the next.

Stages decide row by row, whatever the ids: null ids and ids that come more than once are
allowed, and of equal texts (or near copies) one row stays. That is the row of the largest
(of near copies the smallest) id; a null id stays only if no other id is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from boostlab.llm.common import settled, table
from boostlab.session import drop_dir, settled_alone

#: SQL has no conditional random field and no packing; tests compare the stages with brute
#: force and check the held-out accuracy of the first.
ORACLE_SQL = None


ROW = "__row"


def _rows(docs: DataFrame, nulls_last: bool = False) -> DataFrame:
    """The rows with a number each (``ROW``) that is the same in every job and goes up with
    ``doc_id``: the id itself, or, where ids are null or come more than once, a number written
    down with the row."""
    twice = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if twice.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    order = [F.asc_nulls_last("doc_id") if nulls_last else F.asc_nulls_first("doc_id"), "__at"]
    placed = docs.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(
        *order).sortWithinPartitions(*order).drop("__at")
    return settled(placed.withColumn(ROW, F.monotonically_increasing_id()))


def _only(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows whose numbers (``doc_id`` of the decisions) were decided to stay, all columns
    as they are."""
    stay = decisions.select(F.col("doc_id").alias("__stays"))
    return rows.join(stay, rows[ROW] == stay["__stays"], "left_semi").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = _rows(docs)
    return _only(rows, toxicity.score(rows, model, doc_id=ROW).filter("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    return _only(rows, exact_dedup.dedupe(rows, doc_id=ROW).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs, nulls_last=True)
    return _only(rows, near_dedup.near_duplicates(rows, doc_id=ROW).filter("kept"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    found = decontamination.find(rows, table(spark, sf_dir, "benchmark"), doc_id=ROW)
    return _only(rows, found.filter("not contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Rows of a stage, and what it wrote on its way, are deleted when
    the next one has read them; the last stage's are left, as its rows are read from them."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = settled_alone(spark, lambda d=docs, s=stage: s(spark, d, sf_dir))
        if last:
            drop_dir(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
