"""Boosting spelled out in SQL, as the oracle of small fits."""

from __future__ import annotations

from itertools import product

import numpy as np

from boostlab.operators.grow import Growth, offered_features, poisson_ceilings
from boostlab.registry.shape import BINNED_SQL, BINS, FEATURES
from boostlab.registry.sqlparts import ordered_edges, uniform


def _gain(l2: float) -> str:
    def term(g: str, h: str) -> str:
        return f"coalesce(({g}) * ({g}) / nullif({h} + {l2}::DOUBLE, 0), 0)"

    gain = f"{term('gl', 'hl')} + {term('gt - gl', 'ht - hl')} - {term('gt', 'ht')}"
    return f"round(0.5::DOUBLE * ({gain}) * 1e9) / 1e9"


def _level(state: str, out: str, policy: str, num_leaves: int, l2: float,
           min_rows: int, least: str = "1", offered: str = "true") -> list[str]:
    """CTEs from rows at paths (``state``) to the splits of a level and rows one level on."""
    grid = (
        f"(SELECT path, feature, bin FROM (SELECT DISTINCT path FROM {state}) p, "
        f"(SELECT DISTINCT feature FROM binned) f, range(0, {BINS}) b(bin))"
    )
    sums = (
        f"SELECT path, feature, bin, sum(g) AS g, sum(h) AS h, sum(w) AS n FROM {state} JOIN binned "
        f"USING (row_id) WHERE len(path) = {out.count('x')} AND ({offered}) GROUP BY ALL"
    )
    if policy == "symmetric":
        sums = (
            f"SELECT path, feature, bin, coalesce(g, 0) AS g, coalesce(h, 0) AS h, coalesce(n, 0) AS n "
            f"FROM {grid} cells LEFT JOIN ({sums}) s USING (path, feature, bin)"
        )
    sides = (
        f"SELECT path, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, "
        f"sum(g) OVER v AS gt, sum(h) OVER v AS ht, sum(n) OVER w AS nl, sum(n) OVER v AS nt "
        f"FROM ({sums}) "
        f"WINDOW w AS (PARTITION BY path, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), "
        f"v AS (PARTITION BY path, feature)"
    )
    gains = f"SELECT *, {_gain(l2)} AS gain FROM ({sides})"
    if policy == "symmetric":
        best = (
            f"SELECT p.path, b.feature, b.bin FROM (SELECT feature, bin, round(sum(gain) * 1e9) / 1e9 AS gain "
            f"FROM ({gains}) GROUP BY ALL ORDER BY gain DESC, feature, bin LIMIT 1) b, "
            f"(SELECT DISTINCT path FROM {state}) p WHERE b.gain > 0"
        )
    else:
        best = (
            f"SELECT path, feature, bin, gain FROM ({gains}) "
            f"WHERE hl >= {least} AND ht - hl >= {least} AND gain > 0 "
            f"AND nl >= {min_rows} AND nt - nl >= {min_rows} "
            f"QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, feature, bin) = 1"
        )
        if policy == "leaf" and out.count("x") == 1:
            best += f" ORDER BY gain DESC, path LIMIT {num_leaves - 2}"
    moved = (
        f"SELECT s.* REPLACE (CASE WHEN t.path IS NULL THEN s.path WHEN x.bin > t.bin "
        f"THEN s.path || 'R' ELSE s.path || 'L' END AS path) FROM {state} s "
        f"LEFT JOIN {out}_best t USING (path) LEFT JOIN binned x ON x.row_id = s.row_id "
        f"AND x.feature = t.feature"
    )
    return [f"{out}_best AS MATERIALIZED ({best})", f"{out} AS MATERIALIZED ({moved})"]


def _binned(used: str) -> str:
    """Bins of all rows, with the edges of those used."""
    binned = BINNED_SQL.replace("binned AS (", "binned AS MATERIALIZED (")
    for feature in FEATURES:
        binned = binned.replace(
            ordered_edges(feature, "train", BINS),
            ordered_edges(feature, f"(SELECT * FROM train WHERE {used})", BINS))
    return binned


def boost_sql(final: str, rounds: int, depth: int, policy: str = "level", num_leaves: int = 0,
              eta: float = 0.3, l2: float = 1.0, min_rows: int = 0,
              start: str = "0.0::DOUBLE", least: str = "1", used: str = "true") -> str:
    """A fit over the order features, then ``final`` over what it made.

    ``used`` tells the rows to fit on; the others are only passed down the trees.
    ``final`` may read ``nodes`` (tree, path, feature, threshold, leaf), ``binned``
    and the margins ``m0`` .. ``m<rounds>`` (row_id, label, margin).
    """
    parts = [
        _binned(used),
        f"m0 AS MATERIALIZED (SELECT row_id, label, {start} AS margin FROM train)",
    ]
    nodes = []
    for r in range(rounds):
        state = f"r{r}_"
        parts.append(
            f"{state} AS MATERIALIZED (SELECT row_id, '' AS path, w * (p - label) AS g, "
            f"w * p * (1 - p) AS h, w FROM (SELECT row_id, label, 1 / (1 + exp(-margin)) AS p, "
            f"({used})::INT AS w FROM m{r}))"
        )
        for level in range(depth):
            out = f"r{r}_" + "x" * level + "y"
            parts += _level(state, out, policy, num_leaves, l2, min_rows, least)
            nodes.append(
                f"SELECT {r} AS tree, path, feature AS f, bin, NULL AS leaf FROM {out}_best"
            )
            state = out
        # Symmetric trees keep leaves no row reaches.
        empty = "" if policy != "symmetric" else " UNION ALL ".join(
            [""] + [f"SELECT '{''.join(way)}', 0, 0" for way in product("LR", repeat=depth)]
        )
        parts.append(
            f"v{r} AS MATERIALIZED (SELECT path, -{eta}::DOUBLE * sum(g) / (sum(h) + {l2}::DOUBLE) "
            f"+ 0 AS value FROM (SELECT path, g, h FROM {state}{empty}) GROUP BY path)"
        )
        nodes.append(f"SELECT {r}, path, NULL, NULL, value FROM v{r}")
        parts.append(
            f"m{r + 1} AS MATERIALIZED (SELECT row_id, label, margin + value AS margin "
            f"FROM m{r} JOIN {state} USING (row_id) JOIN v{r} USING (path))"
        )
    return "WITH " + ",\n".join([*parts, *_named(nodes, "tree")]) + "\n" + final


def _named(nodes: list[str], ids: str) -> list[str]:
    """CTEs from node rows to ``nodes``, with names of features and thresholds."""
    names = "CASE f " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FEATURES)) + " END"
    return [
        f"named AS (SELECT *, {names} AS feature FROM ({' UNION ALL '.join(nodes)}))",
        f"nodes AS (SELECT {ids}, path, n.feature, list_sort(cuts)[bin + 1] AS threshold, leaf "
        "FROM named n LEFT JOIN cuts c ON c.name = n.feature)",
    ]


def forest_sql(growth: Growth, seeds: dict[tuple[int, int], int], depth: int,
               used: str = "true", final: str = "") -> str:
    """Trees of (member, tree) over the order features, grown apart from each other.

    ``depth`` is 2 at most, so nodes are numbered 0 (the root), 1 and 2. ``used`` tells the
    rows to fit on; the others are only passed down the trees. ``final`` may read ``nodes``
    and ``voted`` (row_id, label, p: the mean of the members' probabilities).
    """
    share = f"(SELECT avg(label) FROM train WHERE {used})"
    numbers = {"": 0, "L": 1, "R": 2}
    slope = "1.0::DOUBLE" if growth.objective == "mean" else f"({share} * (1 - {share}))"
    # The third kind asks for the weight of so many rows, at the share of class 1.
    least = str(growth.min_child) if growth.min_child == 1.0 else f"(20 * {share} * (1 - {share}))"
    parts = [_binned(used)]
    nodes, leaves = [], []
    for (member, tree), seed in seeds.items():
        drawn, name = uniform(seed, "rows", "row_id"), f"f{member}_{tree}_"
        if growth.bootstrap:
            ceilings = ", ".join(f"'{float(c)!r}'" for c in poisson_ceilings())
            drawn = f"len(list_filter([{ceilings}]::DOUBLE[], lambda c: c <= {drawn}))"
        else:
            drawn = f"({drawn} < {growth.row_share}::DOUBLE)::INT"
        parts.append(
            f"{name} AS MATERIALIZED (SELECT row_id, '' AS path, w * ({share} - label) AS g, "
            f"w * {slope} AS h, w FROM "
            f"(SELECT row_id, label, {drawn} * ({used})::INT AS w FROM train))"
        )
        state = name
        for level in range(depth):
            out = name + "x" * level + "y"
            offered = " OR ".join(
                f"(path = '{path}' AND feature IN "
                f"({', '.join(map(str, np.flatnonzero(offered_features(growth, seed, node, len(FEATURES)))))}))"
                for path, node in numbers.items() if len(path) == level)
            parts += _level(state, out, growth.policy, growth.num_leaves or 0, growth.l2, 0, least,
                            offered)
            nodes.append(f"SELECT {member} AS member, {tree} AS tree, path, feature AS f, bin, "
                         f"NULL AS leaf FROM {out}_best")
            state = out
        value = f"-sum(g) / (sum(h) + {growth.l2}::DOUBLE) + 0"
        nodes.append(f"SELECT {member}, {tree}, path, NULL, NULL, {value} FROM {state} GROUP BY path")
        leaves.append(
            f"SELECT {member} AS member, row_id, value FROM {state} JOIN "
            f"(SELECT path, {value} AS value FROM {state} GROUP BY path) v USING (path)")
    own = f"avg(value) + {share}" if growth.objective == "mean" else (
        f"1 / (1 + exp(-(avg(value) + ln({share} / (1 - {share})))))")
    voted = (
        f"voted AS (SELECT row_id, label, avg(p) AS p FROM (SELECT member, row_id, {own} AS p "
        f"FROM ({' UNION ALL '.join(leaves)}) GROUP BY member, row_id) JOIN train USING (row_id) "
        f"GROUP BY row_id, label)")
    final = final or (
        "SELECT member, tree, path, feature, threshold, round(leaf, 6) AS leaf FROM nodes")
    return "WITH " + ",\n".join([*parts, *_named(nodes, "member, tree"), voted]) + "\n" + final


NODES = "SELECT tree, path, feature, threshold, round(leaf, 6) AS leaf FROM nodes"


def quality_sql(margins: str, used: str, digits: int = 9) -> str:
    """The metrics of the rows a fit did not use, over their margins."""
    return voted_quality_sql(
        f"(SELECT row_id, label, 1 / (1 + exp(-margin)) AS p FROM {margins})", used, digits)


def voted_quality_sql(rows: str, used: str, digits: int = 9) -> str:
    """The metrics of the rows a fit did not use, over ``row_id, label, p``."""
    return f"""SELECT n_rows, round(accuracy, {digits}) AS accuracy,
  round(logloss, {digits}) AS logloss, round(auc, {digits}) AS auc
FROM (SELECT count(*) AS n_rows, avg(((p > 0.5)::INT = label)::INT) AS accuracy,
             avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS logloss
      FROM {rows} WHERE NOT ({used})),
     (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc
      FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING
                                                     AND 1 PRECEDING), 0) AS below
            FROM (SELECT p, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg
                  FROM (SELECT label, round(p, 12) AS p FROM {rows} WHERE NOT ({used}))
                  GROUP BY p)))"""
