"""Exact quality metrics as distributed aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlab.operators.ordered import add_ranges, running_sums
from boostlab.session import settled

CLIP = 1e-15


def accuracy(label: Column, prediction: Column) -> Column:
    """Aggregate: share of rows whose decision equals the label."""
    return F.avg((label == prediction).cast("double"))


def row_logloss(label: Column, proba: Column) -> Column:
    """Log loss of one row, with the probability kept off 0 and 1."""
    p = F.least(F.greatest(proba, F.lit(CLIP)), F.lit(1.0 - CLIP))
    return -(label * F.ln(p) + (F.lit(1) - label) * F.ln(F.lit(1.0) - p))


def logloss(label: Column, proba: Column) -> Column:
    """Aggregate: mean log loss."""
    return F.avg(row_logloss(label, proba))


def score_counts(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """Positives and negatives of every distinct score, and the negatives below it.

    Rows collapse to one per distinct score before anything is ordered, and the
    order is taken range by range, so neither a tied score nor a large number of
    distinct scores ends in one task. The counts are kept, so that the rows
    themselves, and the scoring behind them, are gone through once.
    """
    counted = settled(
        df.groupBy(*by, F.col(score).cast("double").alias(score)).agg(
            F.sum(F.col(label)).cast("long").alias("pos"),
            F.sum(1 - F.col(label)).cast("long").alias("neg"),
        )
    )
    ranged = add_ranges(counted, [score])
    return running_sums(ranged, score, f"{score}_range", ["neg"], by)


def auc_of_counts() -> Column:
    """Aggregate over :func:`score_counts`: ties count one half."""
    pos, neg, before = F.col("pos"), F.col("neg"), F.col("neg_before")
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return F.try_divide(F.sum(pos * (before + neg / F.lit(2.0))), pairs)


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """Exact ROC AUC; null where only one class occurs."""
    return score_counts(df, label, score, by).groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), auc_of_counts().alias("auc")
    )


def evaluate(df: DataFrame, label: str = "label", proba: str = "proba") -> DataFrame:
    """One row: rows, accuracy, log loss and AUC, all from the counts per score."""
    counts = score_counts(df, label, proba)
    pos, neg, p = F.col("pos"), F.col("neg"), F.col(proba)
    n_rows = F.sum(pos + neg)
    right = F.when(p > 0.5, pos).otherwise(neg)
    loss = pos * row_logloss(F.lit(1), p) + neg * row_logloss(F.lit(0), p)
    return counts.agg(
        n_rows.alias("n_rows"),
        (F.sum(right) / n_rows).alias("accuracy"),
        (F.sum(loss) / n_rows).alias("logloss"),
        auc_of_counts().alias("auc"),
    )
