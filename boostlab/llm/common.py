"""What the operators share: tables, plain-letter lowering, words, settled tables."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.session import settled

__all__ = ["ALNUM_WORD", "empty_if_null", "lowered", "lowered_bytes", "numbered", "settled",
           "table"]

#: Runs of characters other than ASCII controls, space, punctuation and capitals, over
#: UTF-8 bytes: bytes of characters beyond ASCII belong to words.
ALNUM_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lowered(text: Column) -> Column:
    """Lower-case A-Z alone; null becomes the empty text."""
    return F.translate(empty_if_null(text), string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame) -> DataFrame:
    """A number per row (``row``), the same in every job: ``doc_id``, or, where ids are null or
    come more than once, a number written down with the row."""
    twice = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if twice.isEmpty():
        return rows.withColumn("row", F.col("doc_id"))
    return settled(rows.withColumn("row", F.monotonically_increasing_id()))


def lowered_bytes(text: str | None) -> bytes:
    """The UTF-8 bytes with A-Z lower-cased, inside tasks; null becomes empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
