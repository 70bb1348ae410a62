"""Scans of tool output: device samples, inventory, key/value text, result lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_FIELDS = ["device_id", "util", "mem_used", "mem_total"]


def trimmed_fields(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda part: F.trim(part))


def parse_samples(polls: DataFrame, ts: str = "ts", text: str = "text") -> DataFrame:
    """Device samples of polls, each a text with one comma-separated line per device.

    Lines with fewer than four fields are skipped. A number that does not parse
    spoils its whole poll. A device named twice keeps its last line.
    """
    lines = F.split(F.trim(F.col(text)), "\n")
    wide = F.filter(F.transform(lines, trimmed_fields), lambda f: F.size(f) >= 4)
    numbers = F.transform(
        wide,
        lambda f, i: F.struct(
            F.get(f, 0).try_cast("int").alias("device_id"), i.alias("line"),
            *[F.get(f, k + 1).try_cast("int").alias(n) for k, n in enumerate(SAMPLE_FIELDS[1:])],
        ),
    )
    spoiled = F.exists(
        "samples",
        lambda s: s["device_id"].isNull() | s["util"].isNull()
        | s["mem_used"].isNull() | s["mem_total"].isNull(),
    )
    # Sorted by device and line, the last line of a device is followed by another device.
    last_ones = F.filter(
        "samples",
        lambda s, i: ~F.coalesce(
            F.get("samples", i + 1)["device_id"] == s["device_id"], F.lit(False)),
    )
    return (
        polls.select(ts, F.array_sort(numbers).alias("samples"))
        .filter(~spoiled)
        .select(ts, F.explode(last_ones).alias("s"))
        .select(ts, *[F.col(f"s.{n}").alias(n) for n in SAMPLE_FIELDS])
    )


def parse_inventory(df: DataFrame, line: str = "line") -> DataFrame:
    """Devices ``name, memory_mb, driver`` of lines with at least three fields."""
    from boostlab.functions.scalars import digits_or_zero

    fields = F.col("fields")
    memory = F.trim(F.replace(F.get(fields, 1), F.lit(" MiB"), F.lit("")))
    return (
        df.withColumn("fields", trimmed_fields(F.col(line)))
        .filter(F.size("fields") >= 3)
        .withColumns({
            "name": F.get(fields, 0),
            "memory_mb": digits_or_zero(memory),
            "driver": F.get(fields, 2),
        })
        .drop("fields", line)
    )


def parse_key_values(df: DataFrame, line: str = "line") -> DataFrame:
    """Rows ``key, value`` for the processor model and count lines; other lines drop out."""
    text = F.col(line)
    model = F.contains(text, F.lit("Model name:"))
    count = (
        F.contains(text, F.lit("CPU(s):"))
        & ~F.contains(text, F.lit("NUMA"))
        & ~F.contains(text, F.lit("On-line"))
    )
    key = F.when(model, "cpu_model").when(count, "cpu_count")
    return (
        df.withColumns({"key": key, "value": F.trim(F.get(F.split(text, ":"), 1))})
        .filter(F.col("key").isNotNull())
        .drop(line)
    )


def first_line(df: DataFrame, keep: Column, doc: str, line_no: str, line: str = "line") -> DataFrame:
    """The first kept line of every document, null where it has none.

    A minimum by line number, so long documents combine on the map side.
    """
    found = F.min(F.when(keep, F.struct(F.col(line_no), F.col(line))))
    return df.groupBy(doc).agg(found.alias("hit")).select(doc, F.col(f"hit.{line}").alias(line))


def first_release_line(df: DataFrame, doc: str, line_no: str, line: str = "line") -> DataFrame:
    keep = F.contains(F.lower(line), F.lit("release"))
    hit = first_line(df, keep, doc, line_no, line)
    return hit.select(doc, F.trim(line).alias("cuda_version"))


def parse_result_lines(df: DataFrame, doc: str, line_no: str, line: str = "line") -> DataFrame:
    """Metrics of the first ``RESULT:`` line of every document; none gives nulls."""
    hit = first_line(df, F.startswith(line, F.lit("RESULT:")), doc, line_no, line)
    pairs = F.str_to_map(F.replace(line, F.lit("RESULT:"), F.lit("")), F.lit(","), F.lit("="))
    return hit.select(doc, pairs.alias("m")).select(
        doc,
        F.col("m").isNotNull().alias("found"),
        *[F.col("m")[k].cast("double").alias(k) for k in ("time", "accuracy", "auc")],
    )
