"""Combining the predictions of ensemble members."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostlab.functions.scalars import decide, int_div


def soft_vote(probas: Sequence[Column]) -> Column:
    """Unweighted mean of member probabilities."""
    return reduce(add, probas) / F.lit(float(len(probas)))


def hard_vote(probas: Sequence[Column]) -> Column:
    """Majority of member decisions; an even tie gives class 0."""
    votes = reduce(add, [decide(p) for p in probas])
    return (votes / F.lit(float(len(probas))) > 0.5).cast("int")


def soft_vote_long(df: DataFrame, row_id: str = "row_id", proba: str = "proba") -> DataFrame:
    """Soft vote of rows ``(row_id, member, proba)``."""
    return df.groupBy(row_id).agg(F.avg(proba).alias("proba"))


def members_long(df: DataFrame, names: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """One row per (row, member) of member columns."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return df.select(row_id, F.expr(f"stack({len(names)}, {pairs}) as (member, proba)"))


def members_wide(df: DataFrame, names: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Member rows aligned into one column per named member."""
    return df.groupBy(row_id).pivot("member", list(names)).agg(F.max("proba"))


def trees_per_member(n_trees: Column, members: Column) -> Column:
    """Whole trees each member fits; the remainder is dropped."""
    return int_div(n_trees, members)
