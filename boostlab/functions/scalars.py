"""Scalar expressions used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def decide(proba: Column) -> Column:
    """Class 1 only strictly above one half."""
    return (proba > F.lit(0.5)).cast("int")


def library(name: Column) -> Column:
    """The part of a configuration name before the first underscore."""
    return F.split(name, "_").getItem(0)


def is_cpu(name: Column) -> Column:
    return F.contains(name, F.lit("cpu"))


def ratio(over: Column, under: Column) -> Column:
    """Null where the divisor is zero or missing."""
    return F.try_divide(over, under)


def speedup_text(speedup: Column, digits: int = 1) -> Column:
    """``2.5x``, or ``-`` where there is no speedup to show."""
    return F.when(speedup.isNull(), "-").otherwise(F.format_string(f"%.{digits}fx", speedup))


def faster_flag(speedup: Column) -> Column:
    return F.when(speedup > 1, "faster").otherwise("slower")


def efficiency_note(percent: Column) -> Column:
    # The bounds and notes of the scaling report.
    return (
        F.when(percent > 80, "Excellent scaling")
        .when(percent > 50, "Good scaling")
        .when(percent > 25, "Limited by single-machine parallelism")
        .otherwise("Overhead dominates")
    )


def leaves_of_depth(depth: Column) -> Column:
    return F.pow(F.lit(2), depth).cast("int")


def int_div(over: Column, under: Column) -> Column:
    """Integer quotient of whole numbers, null when dividing by zero."""
    return F.call_function("div", over, F.nullif(under, F.lit(0)))


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def digits_or_zero(text: Column) -> Column:
    """The number a text of digits stands for, 0 for any other text."""
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("int")), F.lit(0))
