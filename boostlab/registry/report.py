"""Result documents and comparison reports over the result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from boostlab.functions.scalars import is_cpu
from boostlab.plans import reports, sweep
from boostlab.registry.base import query
from boostlab.registry.sqlparts import PUBLISHED, RUNS, SIZES
from boostlab.session import run_dir
from boostlab.sources import relations, results
from boostlab.streaming import telemetry


def _gpu_stats(spark, sf_dir):
    """A ``gpu_stats`` map per round count, from samples spread over the runs."""
    bucket = F.col("event_id") % 3
    iterations = F.when(bucket == 0, 100).when(bucket == 1, 500).otherwise(1000)
    events = relations.table(spark, sf_dir, "events")
    samples = events.select(
        iterations.alias("iterations"),
        (F.col("user_id") % 4).cast("int").alias("device_id"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("util"),
    )
    return results.stats_map(telemetry.rollup(samples, ("iterations",)), ["iterations"])


def _runs_with_stats(spark, sf_dir):
    """CPU runs have an empty map, GPU runs the devices of their round count."""
    runs = relations.runs(spark, sf_dir)
    empty = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<double>")
    )
    joined = runs.join(_gpu_stats(spark, sf_dir), "iterations", "left")
    stats = F.when(is_cpu(F.col("name")) | F.col("gpu_stats").isNull(), empty)
    return joined.withColumn("gpu_stats", stats.otherwise(F.col("gpu_stats")))


def _document(spark, sf_dir):
    """One document of the runs, written to the shared folder and read back."""
    benches = results.nest_results(_runs_with_stats(spark, sf_dir))
    path = run_dir(spark, "results")
    results.write_document(benches, path)
    return results.read_documents(spark, path)


_STATS = """stats AS (
  SELECT CASE event_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 500 ELSE 1000 END AS iterations,
         (user_id % 4)::INT AS device_id, round(avg(least(100, floor(value))::INT), 1) AS avg_util,
         max(least(100, floor(value)))::INT AS max_util
  FROM events GROUP BY 1, 2)"""


@query("results_nest", f"""WITH {RUNS}
SELECT iterations, count(*) AS n_configs, string_agg(name, ',' ORDER BY pos, name) AS names,
       round(sum(time_seconds), 4) AS total_seconds
FROM runs GROUP BY iterations""")
def q_results_nest(spark, sf_dir):
    """The nested document, seen through its maps in stored order."""
    benches = results.nest_results(_runs_with_stats(spark, sf_dir))
    one = benches.select(F.explode("benchmarks").alias("b")).select("b.iterations", "b.results")
    times = F.transform(F.map_values("results"), lambda r: r["time_seconds"])
    return one.select(
        "iterations",
        F.size("results").cast("bigint").alias("n_configs"),
        F.concat_ws(",", F.map_keys("results")).alias("names"),
        F.round(F.aggregate(times, F.lit(0.0), lambda a, t: a + t), 4).alias("total_seconds"),
    )


@query("results_flatten", f"""WITH {RUNS}
SELECT iterations, name, time_seconds, accuracy, auc FROM runs""")
def q_results_flatten(spark, sf_dir):
    flat = results.flatten_results(_document(spark, sf_dir))
    return flat.drop("gpu_stats")


@query("device_stats_long", f"""WITH {RUNS}, {_STATS}
SELECT r.iterations, r.name, s.device_id, s.avg_util, s.max_util
FROM runs r LEFT JOIN stats s ON r.iterations = s.iterations AND NOT contains(r.name, 'cpu')""")
def q_device_stats_long(spark, sf_dir):
    return results.device_stats_long(results.flatten_results(_document(spark, sf_dir)))


_CPU_SQL = f"""WITH {RUNS}, named AS (SELECT *, split_part(name, '_', 1) AS lib FROM runs),
cpu AS (SELECT iterations, lib, arg_max(time_seconds, pos) AS cpu_time FROM named
        WHERE contains(name, 'cpu') GROUP BY 1, 2),
joined AS (
  SELECT n.*, CASE WHEN cpu_time <> 0 AND NOT contains(name, 'cpu') THEN cpu_time / time_seconds END AS speedup
  FROM named n LEFT JOIN cpu USING (iterations, lib))"""


@query("speedup_vs_cpu", f"""{_CPU_SQL}
SELECT iterations, name, time_seconds, accuracy, auc, round(speedup, 6) AS speedup,
       coalesce(printf('%.1fx', speedup), '-') AS speedup_text FROM joined""")
def q_speedup_vs_cpu(spark, sf_dir):
    shown = reports.speedup_vs_cpu(relations.runs(spark, sf_dir))
    return shown.withColumn("speedup", F.round("speedup", 6))


def _single_and_distributed(spark, sf_dir):
    """The CPU-less split of the runs: 1gpu rows as single, 4gpu_dask rows as distributed."""
    runs = relations.runs(spark, sf_dir)
    rows = runs.select(
        "iterations", F.split("name", "_")[0].alias("lib"),
        F.col("time_seconds").alias("time"), "auc", "name",
    )
    ends = lambda text: F.endswith(F.col("name"), F.lit(text))
    return rows.filter(ends("1gpu")), rows.filter(ends("4gpu_dask"))


_PAIR_SQL = f"""WITH {RUNS}, rows AS (SELECT *, split_part(name, '_', 1) AS lib FROM runs),
pairs AS (
  SELECT s.iterations, s.lib, s.time_seconds AS t_single, s.auc AS auc_single,
         d.time_seconds AS t_dist, d.auc AS auc_dist, s.time_seconds / d.time_seconds AS speedup
  FROM rows s JOIN rows d ON s.iterations = d.iterations AND s.lib = d.lib
  WHERE s.name LIKE '%1gpu' AND d.name LIKE '%4gpu_dask')"""


@query("speedup_single_vs_dist", f"""{_PAIR_SQL}
SELECT * REPLACE (round(speedup, 6) AS speedup) FROM pairs""")
def q_speedup_single_vs_dist(spark, sf_dir):
    single, dist = _single_and_distributed(spark, sf_dir)
    compared = reports.single_vs_distributed(single, dist, ["iterations", "lib"])
    return compared.withColumn("speedup", F.round("speedup", 6))


@query("scaling_efficiency", f"""{_PAIR_SQL}, scaled AS (
  SELECT iterations, lib, speedup / 2 * 100 AS efficiency FROM pairs)
SELECT iterations, lib, round(efficiency, 4) AS efficiency,
       CASE WHEN efficiency > 80 THEN 'Excellent scaling' WHEN efficiency > 50 THEN 'Good scaling'
            WHEN efficiency > 25 THEN 'Limited by single-machine parallelism'
            ELSE 'Overhead dominates' END AS note
FROM scaled""")
def q_scaling_efficiency(spark, sf_dir):
    single, dist = _single_and_distributed(spark, sf_dir)
    compared = reports.single_vs_distributed(single, dist, ["iterations", "lib"])
    return reports.scaling_efficiency(compared, 2).select(
        "iterations", "lib", F.round("efficiency", 4).alias("efficiency"), "note"
    )


@query("speedup_vs_named", f"""WITH {RUNS}
SELECT r.iterations, r.name, r.time_seconds, round(b.time_seconds / r.time_seconds, 6) AS speedup, r.auc
FROM runs r LEFT JOIN runs b ON b.iterations = r.iterations AND b.name = 'urgent_cpu'""")
def q_speedup_vs_named(spark, sf_dir):
    shown = reports.speedup_vs_named(relations.runs(spark, sf_dir), "urgent_cpu")
    return shown.select("iterations", "name", "time_seconds",
                        F.round("speedup", 6).alias("speedup"), "auc")


@query("best_of", f"""WITH {RUNS}
SELECT DISTINCT iterations,
  first_value(name) OVER f AS fastest, first_value(time_seconds) OVER f AS time_seconds,
  first_value(name) OVER g AS best_auc_name, first_value(auc) OVER g AS best_auc
FROM runs WINDOW f AS (PARTITION BY iterations ORDER BY time_seconds, pos, name),
                 g AS (PARTITION BY iterations ORDER BY auc DESC, pos, name)""")
def q_best_of(spark, sf_dir):
    return reports.best_of(relations.runs(spark, sf_dir))


@query("compare_runs", f"""WITH {RUNS}, {PUBLISHED}
SELECT coalesce(r.iterations, p.iterations) AS iterations, coalesce(r.name, p.name) AS name,
       round(r.time_seconds - p.time_seconds, 6) AS time_delta, round(r.auc - p.auc, 6) AS auc_delta,
       CASE WHEN p.name IS NULL THEN 'only_ours' WHEN r.name IS NULL THEN 'only_published'
            WHEN abs(r.auc - p.auc) <= 0.005::DOUBLE THEN 'same' ELSE 'differs' END AS status
FROM runs r FULL JOIN published p ON r.iterations = p.iterations AND r.name = p.name""")
def q_compare_runs(spark, sf_dir):
    return reports.compare_runs(
        relations.runs(spark, sf_dir), relations.published_runs(spark, sf_dir), 0.005
    )


@query("results_union", f"""WITH {RUNS}, {PUBLISHED}
SELECT iterations, name, time_seconds, auc, accuracy, pos FROM runs
UNION ALL SELECT iterations, name, time_seconds, auc, NULL, NULL FROM published""")
def q_results_union(spark, sf_dir):
    return reports.union_results(
        relations.runs(spark, sf_dir), relations.published_runs(spark, sf_dir)
    )


@query("sweep_speedup", f"""WITH {SIZES}
SELECT *, round(t_single / t_dist, 6) AS speedup,
       CASE WHEN t_single / t_dist > 1 THEN 'faster' ELSE 'slower' END AS flag FROM sizes""")
def q_sweep_speedup(spark, sf_dir):
    return reports.sweep_speedup(relations.bench_sizes(spark, sf_dir)).withColumn(
        "speedup", F.round("speedup", 6)
    )


@query("crossover", f"""WITH {SIZES}, hits AS (
  SELECT name, n_samples FROM sizes WHERE t_single / t_dist > 1 ORDER BY n_samples, name LIMIT 1)
SELECT name, n_samples, coalesce('distributed becomes faster at ' || name,
                                 'single is faster for all sizes') AS message
FROM (SELECT 1) LEFT JOIN hits ON true""")
def q_crossover(spark, sf_dir):
    return reports.crossover(relations.bench_sizes(spark, sf_dir))


@query("overhead_rate", f"""WITH {SIZES}, costs AS (
  SELECT name, n_samples * n_features * 4 / 1e6 AS megabytes, t_dist - t_single AS overhead FROM sizes)
SELECT name, round(megabytes, 6) AS megabytes, round(overhead, 6) AS overhead,
       round(megabytes / nullif(overhead, 0), 4) AS rate FROM costs""")
def q_overhead_rate(spark, sf_dir):
    return reports.overhead_rate(relations.bench_sizes(spark, sf_dir))


@query("exchange_volume", f"""WITH {RUNS}
SELECT iterations, name, depth::INT AS depth, (2 ** depth * 200 * 1024)::BIGINT AS per_tree,
       (2 ** depth * 200 * 1024)::BIGINT * iterations AS per_run
FROM runs, (VALUES (6), (8), (10)) t(depth)""")
def q_exchange_volume(spark, sf_dir):
    return reports.exchange_volume(relations.runs(spark, sf_dir), [6, 8, 10])


@query("run_status", """WITH log AS (
  SELECT event_type AS name,
         CASE WHEN value < 5 THEN 'timeout' WHEN value < 20 THEN 'failed' ELSE 'passed' END AS outcome
  FROM events)
SELECT name, count(*) FILTER (outcome = 'passed') AS passed,
       count(*) FILTER (outcome <> 'passed') AS not_passed, bool_and(outcome = 'passed') AS all_passed
FROM log GROUP BY name""")
def q_run_status(spark, sf_dir):
    value = F.col("value")
    outcome = F.when(value < 5, "timeout").when(value < 20, "failed").otherwise("passed")
    events = relations.table(spark, sf_dir, "events")
    return reports.run_status(events.select(F.col("event_type").alias("name"),
                                            outcome.alias("outcome")))


@query("config_grid", f"""WITH {RUNS}
SELECT DISTINCT iterations, config FROM runs, (VALUES ('xgboost_cpu'), ('xgboost_1gpu'),
  ('xgboost_4gpu_dask'), ('catboost_cpu'), ('catboost_1gpu'), ('catboost_4gpu'), ('lightgbm_cpu'),
  ('lightgbm_1gpu'), ('lightgbm_4gpu'), ('lightgbm_4gpu_dask'), ('rf_sklearn'), ('rf_xgboost'),
  ('rf_lightgbm')) c(config) WHERE config NOT LIKE 'catboost%' AND config NOT LIKE '%1gpu'""")
def q_config_grid(spark, sf_dir):
    """The grid of the round counts that occur, without CatBoost and single-GPU runs."""
    chosen = sweep.Selection(skip_catboost=True, skip_1gpu=True)
    rounds = relations.runs(spark, sf_dir).select("iterations").distinct()
    return sweep.config_grid(rounds, chosen)


@query("run_metadata")
def q_run_metadata(spark, sf_dir):
    """The metadata record of a run over the order features."""
    n_rows = relations.table(spark, sf_dir, "orders").count()
    return sweep.run_metadata(spark, n_rows, len(relations.ORDER_FEATURES), [100], 6, 0.03)
