"""SQL texts shared by the oracles: the relations of ``sources.relations``."""

from __future__ import annotations


def word(seed: int, tag: str, row_id: str, index: int = 0) -> str:
    digest = f"md5('{seed}:{tag}:' || ({row_id}))"
    return f"('0x' || substr({digest}, {8 * index + 1}, 8))::BIGINT"


def uniform(seed: int, tag: str, row_id: str) -> str:
    return f"({word(seed, tag, row_id)} / 4294967296.0::DOUBLE)"


def normal(seed: int, tag: str, row_id: str) -> str:
    first, second = word(seed, tag, row_id), word(seed, tag, row_id, 1)
    return (
        f"(sqrt(-2.0::DOUBLE * ln(({first} + 1) / 4294967297.0::DOUBLE))"
        f" * cos(2.0::DOUBLE * pi() * ({second} / 4294967296.0::DOUBLE)))"
    )


SCORES = """scores AS (
  SELECT event_id AS row_id, (event_type = 'purchase')::INT AS label,
         round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(value - 50.0::DOUBLE) / 25.0::DOUBLE)), 4) AS score
  FROM events)"""

MEMBERS = (
    SCORES
    + """, members AS (
  SELECT row_id, label, """
    + ", ".join(
        f"0.5::DOUBLE * score + 0.5::DOUBLE * {uniform(i, 'member', 'row_id')} AS p{i}"
        for i in range(1, 5)
    )
    + " FROM scores)"
)

ORDER_FEATURES = f"""lines AS (
  SELECT l_orderkey AS row_id, count(*)::DOUBLE AS f0, sum(l_quantity) AS f1,
         round(avg(l_discount), 6) AS f2, max(l_tax) AS f3
  FROM lineitem GROUP BY l_orderkey),
features AS (
  SELECT o_orderkey AS row_id, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1,
         coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3
  FROM orders LEFT JOIN lines ON o_orderkey = lines.row_id),
train AS (
  SELECT *, (0.01::DOUBLE * f1 + 5.0::DOUBLE * f2
             + 0.2::DOUBLE * {uniform(42, 'x3', 'row_id')} > 1.35::DOUBLE)::INT AS label
  FROM features)"""

TELEMETRY = """telemetry AS (
  SELECT ts, (user_id % 4)::INT AS device_id, least(100, floor(value))::INT AS util,
         floor(value * 10)::INT AS mem_used, 24570 AS mem_total
  FROM events)"""

RUNS = """priced AS (
  SELECT CASE o_orderkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 500 ELSE 1000 END AS iterations,
         CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS pos,
         lower(substr(o_orderpriority, 3)) AS lib, o_orderstatus AS status,
         o_totalprice, o_custkey
  FROM orders),
runs AS (
  SELECT iterations, pos,
         lib || '_' || CASE WHEN lib = 'low' AND status = 'F' THEN '2gpu'
                            WHEN lib = 'high' AND status = 'O' THEN 'cpu_again'
                            WHEN status = 'F' THEN 'cpu' WHEN status = 'O' THEN '1gpu'
                            ELSE '4gpu_dask' END AS name,
         round(avg(o_totalprice) / 1000.0::DOUBLE, 2) AS time_seconds,
         round(avg((o_totalprice > 50000)::INT), 4) AS accuracy,
         round(avg((o_custkey % 25 > 0)::INT), 4) AS auc
  FROM priced GROUP BY 1, 2, 3)"""

PUBLISHED = """published AS (
  SELECT CASE o_custkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 500 ELSE 2000 END AS iterations,
         lower(substr(o_orderpriority, 3)) || '_'
           || CASE WHEN o_orderstatus = 'F' THEN 'cpu' ELSE '1gpu' END AS name,
         round(avg(o_totalprice) / 1000.0::DOUBLE, 2) AS time_seconds,
         round(avg((o_custkey % 25 > 0)::INT), 4) AS auc
  FROM orders GROUP BY 1, 2)"""

SIZES = """sizes AS (
  SELECT 'm' || month(o_orderdate) AS name, count(*) AS n_samples, 50 AS n_features,
         round(avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000.0::DOUBLE END), 2) AS t_single,
         round(avg(CASE WHEN o_orderkey % 2 <> 0 THEN o_totalprice / 1000.0::DOUBLE END), 2) AS t_dist
  FROM orders GROUP BY month(o_orderdate))"""


def ordered_edges(feature: str, source: str, max_bins: int) -> str:
    """Rows ``(feature, edge)`` of one column, by plain ranks."""
    return f"""SELECT DISTINCT '{feature}' AS feature, {feature}::DOUBLE AS edge
  FROM (SELECT {feature}, row_number() OVER (ORDER BY {feature}) AS rank,
               count(*) OVER () AS n FROM {source}) ranked
  WHERE rank IN (SELECT (k * n + {max_bins} - 1) // {max_bins} FROM range(1, {max_bins}) t(k))"""
