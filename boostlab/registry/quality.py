"""Metrics and ensembles over the scored stand-in rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from boostlab.functions.scalars import decide
from boostlab.operators import ensemble, metrics
from boostlab.registry.base import query
from boostlab.registry.sqlparts import MEMBERS, SCORES
from boostlab.sources import relations


@query(
    "decide",
    f"""WITH {SCORES} SELECT row_id, score, (score > 0.5)::INT AS prediction FROM scores""",
)
def q_decide(spark, sf_dir):
    return relations.scores(spark, sf_dir).select(
        "row_id", "score", decide(F.col("score")).alias("prediction")
    )


@query(
    "accuracy",
    f"""WITH {SCORES}
SELECT count(*) AS n_rows, round(avg((label = (score > 0.5)::INT)::INT), 4) AS accuracy
FROM scores""",
)
def q_accuracy(spark, sf_dir):
    scored = relations.scores(spark, sf_dir)
    right = metrics.accuracy(F.col("label"), decide(F.col("score")))
    return scored.agg(F.count("*").alias("n_rows"), F.round(right, 4).alias("accuracy"))


@query(
    "logloss",
    f"""WITH {SCORES}, clipped AS (
  SELECT label, least(greatest(score, 1e-15::DOUBLE), 1.0::DOUBLE - 1e-15::DOUBLE) AS p FROM scores)
SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS logloss FROM clipped""",
)
def q_logloss(spark, sf_dir):
    return relations.scores(spark, sf_dir).agg(
        F.round(metrics.logloss(F.col("label"), F.col("score")), 6).alias("logloss")
    )


@query(
    "roc_auc",
    f"""WITH {SCORES}, counted AS (
  SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM scores GROUP BY score),
ranked AS (
  SELECT pos, neg, coalesce(sum(neg) OVER (
    ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counted)
SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
       round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM ranked""",
)
def q_roc_auc(spark, sf_dir):
    area = metrics.roc_auc(relations.scores(spark, sf_dir), "label", "score")
    return area.withColumn("auc", F.round("auc", 9))


_LONG_SQL = " UNION ALL ".join(
    f"SELECT row_id, label, 'p{i}' AS member, p{i} AS proba FROM members" for i in range(1, 5)
)


@query(
    "member_auc",
    f"""WITH {MEMBERS}, long AS ({_LONG_SQL}), counted AS (
  SELECT member, proba, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg
  FROM long GROUP BY member, proba),
ranked AS (
  SELECT member, pos, neg, coalesce(sum(neg) OVER (
    PARTITION BY member ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM counted)
SELECT member, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
       round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc
FROM ranked GROUP BY member""",
)
def q_member_auc(spark, sf_dir):
    wide = relations.members(spark, sf_dir)
    pairs = ", ".join(f"'{n}', {n}" for n in relations.MEMBERS)
    long = wide.select("label", F.expr(f"stack(4, {pairs}) as (member, proba)"))
    area = metrics.roc_auc(long, "label", "proba", by=["member"])
    return area.withColumn("auc", F.round("auc", 9))


@query(
    "ensemble_soft",
    f"""WITH {MEMBERS}, voted AS (SELECT row_id, (p1 + p2 + p3 + p4) / 4 AS p FROM members)
SELECT row_id, round(p, 9) AS proba, (p > 0.5)::INT AS prediction FROM voted""",
)
def q_ensemble_soft(spark, sf_dir):
    wide = relations.members(spark, sf_dir)
    voted = wide.withColumn("proba", ensemble.soft_vote([F.col(n) for n in relations.MEMBERS]))
    return voted.select(
        "row_id", F.round("proba", 9).alias("proba"), decide(F.col("proba")).alias("prediction")
    )


@query(
    "ensemble_vote",
    f"""WITH {MEMBERS}
SELECT row_id, round((p1 + p2 + p3 + p4) / 4, 9) AS proba,
       (((p1 > 0.5)::INT + (p2 > 0.5)::INT + (p3 > 0.5)::INT + (p4 > 0.5)::INT) / 4.0 > 0.5)::INT
         AS prediction
FROM members""",
)
def q_ensemble_vote(spark, sf_dir):
    columns = [F.col(n) for n in relations.MEMBERS]
    return relations.members(spark, sf_dir).select(
        "row_id",
        F.round(ensemble.soft_vote(columns), 9).alias("proba"),
        ensemble.hard_vote(columns).alias("prediction"),
    )


@query(
    "ensemble_soft_long",
    f"""WITH {MEMBERS} SELECT row_id, round((p1 + p2 + p3 + p4) / 4, 9) AS proba FROM members""",
)
def q_ensemble_soft_long(spark, sf_dir):
    long = ensemble.members_long(relations.members(spark, sf_dir), relations.MEMBERS)
    return ensemble.soft_vote_long(long).withColumn("proba", F.round("proba", 9))


@query(
    "member_pivot",
    f"""WITH {MEMBERS}, long AS ({_LONG_SQL})
SELECT row_id, round(max(proba) FILTER (member = 'p1'), 9) AS p1,
       round(max(proba) FILTER (member = 'p2'), 9) AS p2,
       round(max(proba) FILTER (member = 'p3'), 9) AS p3,
       round(max(proba) FILTER (member = 'p4'), 9) AS p4
FROM long GROUP BY row_id""",
)
def q_member_pivot(spark, sf_dir):
    long = ensemble.members_long(relations.members(spark, sf_dir), relations.MEMBERS)
    wide = ensemble.members_wide(long, relations.MEMBERS)
    return wide.select("row_id", *[F.round(n, 9).alias(n) for n in relations.MEMBERS])


@query(
    "truth_join",
    f"""WITH {SCORES}, predicted AS (SELECT row_id, (score > 0.5)::INT AS prediction FROM scores)
SELECT s.label, p.prediction, count(*) AS n_rows
FROM scores s JOIN predicted p USING (row_id) GROUP BY ALL""",
)
def q_truth_join(spark, sf_dir):
    scored = relations.scores(spark, sf_dir)
    truth = scored.select("row_id", "label")
    predicted = scored.select("row_id", decide(F.col("score")).alias("prediction"))
    return (
        truth.join(predicted, "row_id")
        .groupBy("label", "prediction")
        .agg(F.count("*").alias("n_rows"))
    )


@query(
    "tree_allocation",
    """WITH asked AS (
  SELECT o_custkey AS model_id, count(*) AS n_trees, (o_custkey % 5) AS members
  FROM orders GROUP BY o_custkey)
SELECT model_id, n_trees, members, n_trees // nullif(members, 0) AS per_member,
       members * (n_trees // nullif(members, 0)) AS total_trees FROM asked""",
)
def q_tree_allocation(spark, sf_dir):
    asked = (
        relations.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("model_id"))
        .agg(F.count("*").alias("n_trees"))
        .withColumn("members", F.col("model_id") % 5)
    )
    each = ensemble.trees_per_member(F.col("n_trees"), F.col("members"))
    return asked.select(
        "*", each.alias("per_member"), (F.col("members") * each).alias("total_trees")
    )
