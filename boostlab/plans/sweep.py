"""Sweeps: configurations by name, run one after the other, results as rows."""

from __future__ import annotations

import json
import platform
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boostlab.functions.scalars import file_stamp
from boostlab.operators.boosting import (
    Binned, BoostParams, binned_rows, boost_binned, boost_watched,
)
from boostlab.operators.forest import fit_forest, fit_members, score_members
from boostlab.operators.metrics import evaluate
from boostlab.operators.model import TreeModel, eval_history, score
from boostlab.session import path_exists, scratch
from boostlab.sources import hardware
from boostlab.sources.results import nest_results, stats_map, write_document
from boostlab.streaming.spans import run_stats


@dataclass(frozen=True)
class Selection:
    """Which configurations a sweep runs."""

    gpus: int = 4
    skip_cpu: bool = False
    skip_1gpu: bool = False
    skip_multi_gpu: bool = False
    skip_xgboost: bool = False
    skip_catboost: bool = False
    skip_lightgbm: bool = False
    skip_rf: bool = False

    def names(self) -> list[str]:
        """Configuration names in run order. Several devices need ``gpus`` above one."""
        multi = not self.skip_multi_gpu and self.gpus > 1
        # The suffixes of each library's configurations.
        suffixes = {
            "xgboost": [f"{self.gpus}gpu_dask"],
            "catboost": [f"{self.gpus}gpu"],
            "lightgbm": [f"{self.gpus}gpu", f"{self.gpus}gpu_dask"],
        }
        skipped = {"xgboost": self.skip_xgboost, "catboost": self.skip_catboost,
                   "lightgbm": self.skip_lightgbm}
        chosen = []
        for lib, several in suffixes.items():
            if skipped[lib]:
                continue
            chosen += [] if self.skip_cpu else [f"{lib}_cpu"]
            chosen += [] if self.skip_1gpu else [f"{lib}_1gpu"]
            chosen += [f"{lib}_{s}" for s in several] if multi else []
        if not (self.skip_cpu or self.skip_rf):
            chosen += ["rf_sklearn", "rf_xgboost", "rf_lightgbm"]
        return chosen


def config_grid(rounds: DataFrame, selection: Selection) -> DataFrame:
    """One row per (iterations, configuration): a few names beside every round count."""
    names = F.array(*map(F.lit, selection.names())).cast("array<string>")
    return rounds.select("iterations", F.explode(names).alias("config"))


# The short names of single configurations.
SHORT_NAMES = {
    "xgb-cpu": "xgboost_cpu", "xgb-1gpu": "xgboost_1gpu", "xgb-4gpu": "xgboost_4gpu_dask",
    "cb-cpu": "catboost_cpu", "cb-1gpu": "catboost_1gpu", "cb-4gpu": "catboost_4gpu",
    "lgb-cpu": "lightgbm_cpu", "lgb-1gpu": "lightgbm_1gpu", "lgb-4gpu": "lightgbm_4gpu",
    "lgb-4gpu-dask": "lightgbm_4gpu_dask",
    "rf-sklearn": "rf_sklearn", "rf-xgboost": "rf_xgboost", "rf-lightgbm": "rf_lightgbm",
}


def run_metadata(
    spark: SparkSession, samples: int, features: int, iterations: list[int], depth: int,
    learning_rate: float,
) -> DataFrame:
    """One row: the ``hardware`` and ``parameters`` of a result document."""
    return spark.range(1).select(
        *_metadata(spark, samples, features, iterations, depth, learning_rate))


def _metadata(
    spark: SparkSession, samples: int, features: int, iterations: list[int], depth: int,
    learning_rate: float,
) -> list[Column]:
    # The field names of a result document.
    known = {
        "timestamp": datetime.now().isoformat(),
        "platform": platform.platform(),
        "python_version": platform.python_version(),
        "cpu_count": spark.sparkContext.defaultParallelism,
        "spark_version": pyspark.__version__,
    }
    described = {**{k: F.lit(v) for k, v in known.items()}, **hardware.columns(spark)}
    return [
        F.struct(*[value.alias(name) for name, value in described.items()]).alias("hardware"),
        F.struct(
            F.lit(samples).cast("bigint").alias("samples"),
            F.lit(features).alias("features"),
            F.array(*map(F.lit, iterations)).alias("iterations"),
            F.lit(depth).alias("depth"),
            F.lit(learning_rate).alias("learning_rate"),
            F.lit(2**depth).alias("lightgbm_num_leaves"),
        ).alias("parameters"),
    ]


# Regularisation, leaf sizes and starting margin each library applies unless
# told otherwise, and the depths its forest adds to be comparable.
BOOSTERS = {
    "xgboost": {"growth": "level", "l2": 1.0, "min_child": 1.0, "from_share": True},
    "catboost": {"growth": "symmetric", "l2": 3.0},
    "lightgbm": {"growth": "leaf", "l2": 0.0, "min_child": 1e-3, "min_rows": 20,
                 "from_share": True},
}
FORESTS = {"sklearn": ("bootstrap", 0), "xgboost": ("subsample", 1), "lightgbm": ("bagged", 5)}


@dataclass(frozen=True)
class Trial:
    """What all configurations of a sweep share."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    depth: int = 6
    learning_rate: float = 0.03
    max_bins: int = 256
    seed: int = 42
    binned: Binned | None = None  # training rows binned before, for all configurations
    watch: Binned | None = None  # test rows in the same bins

    def prepared(self) -> Trial:
        """The trial with its rows binned; who asks for it closes them."""
        binned = binned_rows(self.train, self.features, max_bins=self.max_bins)
        watch = binned_rows(self.test, self.features, edges=binned.edges)
        return replace(self, binned=binned, watch=watch)

    def close(self) -> None:
        for held in (self.binned, self.watch):
            if held is not None:
                held.close()


def fit_config(
    trial: Trial, config: str, iterations: int, best_only: bool = True
) -> TreeModel:
    """Fit one configuration. The part after the library names a device in result
    files; here every configuration runs on the session's cores."""
    lib, _, rest = config.partition("_")
    if lib != "rf" and lib not in BOOSTERS:
        raise ValueError(f"unknown configuration: {config}")
    if trial.binned is None:
        ready = trial.prepared()
        try:
            return fit_config(ready, config, iterations, best_only)
        finally:
            ready.close()
    if lib == "rf":
        kind, deeper = FORESTS[rest]
        return fit_forest(trial.binned, kind, iterations, trial.depth + deeper, trial.seed)
    params = BoostParams(
        rounds=iterations, max_depth=trial.depth, learning_rate=trial.learning_rate,
        num_leaves=2**trial.depth, max_bins=trial.max_bins, seed=trial.seed, **BOOSTERS[lib],
    )
    if lib == "catboost" and best_only:
        # This library keeps the model of its best round on the evaluation rows.
        return boost_watched(trial.binned, trial.watch, params).model
    return boost_binned(trial.binned, params)


def round_history(trial: Trial, config: str, iterations: int) -> DataFrame:
    """Log loss of the test rows after every round of one configuration, none of them left
    out: ``name, round, logloss``."""
    model = fit_config(trial, config, iterations, best_only=False)
    return eval_history(trial.test, model).select(F.lit(config).alias("name"), "round", "logloss")


def timed_run(trial: Trial, config: str, iterations: int) -> dict:
    """Fit with the clock on, then measure quality on the test rows. Binning has a clock of
    its own, and takes no time where the trial comes with its rows binned."""
    if trial.binned is None:
        start = time.perf_counter()
        ready = trial.prepared()
        prepared = time.perf_counter() - start
        try:
            return timed_run(ready, config, iterations) | {"prepare_seconds": round(prepared, 2)}
        finally:
            ready.close()
    start = time.perf_counter()
    model = fit_config(trial, config, iterations)
    elapsed = time.perf_counter() - start
    with scratch(trial.test.sparkSession):
        quality = evaluate(score(trial.test, model)).first()
    return {
        "time_seconds": round(elapsed, 2),
        "accuracy": round(quality["accuracy"], 4),
        "auc": None if quality["auc"] is None else round(quality["auc"], 4),
        "trees": len(model.trees),
        "prepare_seconds": 0.0,
    }


def run_single(trial: Trial, name: str, iterations: list[int]) -> dict:
    """One configuration by its short name, for the first round count only."""
    if name not in SHORT_NAMES:
        raise ValueError(f"unknown test: {name}")
    return timed_run(trial, SHORT_NAMES[name], iterations[0])


SWEEP = (
    "iterations int, pos int, name string, time_seconds double, accuracy double, auc double, "
    "trees int, status string, start timestamp, stop timestamp"
)
MEASURED = ("time_seconds", "accuracy", "auc", "trees")
TIMEOUT = "timeout"


class RunLog:
    """The finished runs of a sweep, each committed under its own name when it ends.

    A run's row is one small file that appears whole or not at all, so a sweep that was
    interrupted, wherever, goes on after its last finished run. The log names the trial it
    belongs to; a sweep of another one is refused.
    """

    def __init__(self, spark: SparkSession, folder: str, about: dict) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        about_file = f"{self.folder}/trial.json"
        text = json.dumps(about, sort_keys=True)
        if not path_exists(spark, about_file):
            write_document(spark.createDataFrame([(text,)], "trial string"), about_file)
        held = spark.read.schema("trial string").json(about_file).first()[0]
        if held != text:
            raise ValueError(f"the log of another sweep: {held}, not {text}")

    def finished(self) -> dict[tuple[int, str], tuple]:
        """Rows by round count and name. Failed runs are not finished: they are run again."""
        if not path_exists(self.spark, f"{self.folder}/runs"):
            return {}
        rows = self.spark.read.schema(SWEEP).json(f"{self.folder}/runs")
        return {(r["iterations"], r["name"]): tuple(r) for r in rows.collect()
                if r["status"] in ("ok", TIMEOUT)}

    def commit(self, row: tuple) -> None:
        path = f"{self.folder}/runs/{row[0]}-{row[2]}.json"
        write_document(self.spark.createDataFrame([row], SWEEP), path, replace=True)


def within(spark: SparkSession, group: str, seconds: float | None, work: Callable) -> dict:
    """What ``work`` gives. Its jobs are cancelled when its time is over."""
    context = spark.sparkContext
    context.setJobGroup(group, group, interruptOnCancel=True)
    over = threading.Event()

    def cancel() -> None:
        over.set()
        while over.is_set():  # a fit starts job after job
            context.cancelJobGroup(group)
            time.sleep(0.2)

    # A thread of the JVM's own: the cancelling calls must not inherit the group.
    clock = threading.Timer(seconds, cancel) if seconds else None
    if clock:
        clock.daemon = True
        clock.start()
    try:
        return work()
    except Exception as error:
        if over.is_set():
            raise TimeoutError(f"over {seconds} seconds") from error
        raise
    finally:
        if clock:
            clock.cancel()
        over.clear()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
        context.setLocalProperty("spark.job.interruptOnCancel", None)


def run_sweep(
    trial: Trial, selection: Selection, iterations: list[int],
    run: Callable[[Trial, str, int], dict] = timed_run, log: str | None = None,
    limit_seconds: float | None = None,
) -> DataFrame:
    """Every configuration for every round count; one row each.

    The rows to test on are cached and those to train on binned, once for all
    configurations, before the first clock starts.
    A configuration that fails is a row with its error, one that takes longer than
    ``limit_seconds`` a row with the status ``timeout``, and the sweep goes on. With a
    ``log`` folder (shared, if the driver may come back elsewhere) every row is committed
    when its run ends, and a sweep that is started again runs what is not there yet.
    """
    spark = trial.train.sparkSession
    held = RunLog(spark, log, _identity(trial)) if log else None
    done = held.finished() if held else {}
    wanted = [(rounds, pos, name) for rounds in iterations
              for pos, name in enumerate(selection.names())]
    rows = [(*key, *done[key[0], key[2]][3:]) for key in wanted if (key[0], key[2]) in done]
    left = [key for key in wanted if (key[0], key[2]) not in done]
    if left:
        trial.test.persist().count()
        ready = trial.prepared()
        try:
            for rounds, pos, name in left:
                start, found = _now(), {}
                try:
                    found = within(spark, f"{name}-{rounds}-{uuid.uuid4().hex}", limit_seconds,
                                   lambda: run(ready, name, rounds))
                    status = "ok"
                except TimeoutError:
                    status = TIMEOUT
                except Exception as error:
                    status = f"{type(error).__name__}: {error}"
                rows.append(
                    (rounds, pos, name, *map(found.get, MEASURED), status, start, _now()))
                if held:
                    held.commit(rows[-1])
        finally:
            trial.test.unpersist()
            ready.close()
    order = {(rounds, name): i for i, (rounds, _, name) in enumerate(wanted)}
    rows.sort(key=lambda row: order[row[0], row[2]])
    return spark.createDataFrame(rows, SWEEP)


def _now() -> datetime:
    """The time to the millisecond, as a log keeps it."""
    now = datetime.now()
    return now.replace(microsecond=now.microsecond // 1000 * 1000)


def _identity(trial: Trial) -> dict:
    """What rows of a log must have in common."""
    return {"features": trial.features, "depth": trial.depth, "seed": trial.seed,
            "learning_rate": trial.learning_rate, "max_bins": trial.max_bins}


def sweep_document(
    trial: Trial, selection: Selection, iterations: list[int], folder: str,
    run: Callable[[Trial, str, int], dict] = timed_run, samples: DataFrame | None = None,
    log: str | None = None, limit_seconds: float | None = None,
) -> str:
    """Run a sweep and write its result document, one file under a stamped name; its path.

    Failed configurations have no result and are left out. ``samples`` are device samples
    (``ts, device_id, util``) that are read when the sweep is over: each result holds the
    statistics of its own time span.
    """
    spark = trial.train.sparkSession
    n_rows = trial.train.count() + trial.test.count()
    rows = run_sweep(trial, selection, iterations, run, log, limit_seconds).filter("status = 'ok'")
    key = ["iterations", "name"]
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    if samples is None:
        rows = rows.withColumn("gpu_stats", none)
    else:
        stats = stats_map(run_stats(samples, rows, key, seconds=1), key)
        rows = rows.join(stats, key, "left").withColumn("gpu_stats", F.coalesce("gpu_stats", none))
    about = _metadata(
        spark, n_rows, len(trial.features), iterations, trial.depth, trial.learning_rate)
    stamp = spark.range(1).select(file_stamp(F.current_timestamp())).first()[0]
    # Fixed value: the name of a result document.
    path = f"{folder}/benchmark_results_{stamp}.json"
    write_document(nest_results(rows).select(*about, "benchmarks"), path)
    return path


def compared_changes(lib: str, depth: int) -> dict:
    """What the comparison changes of a kind of forest."""
    # Settings the distributed comparison gives the third kind.
    third = {"row_share": 0.8, "tree_features": 0.8, "num_leaves": 2**depth}
    return third if lib == "lightgbm" else {}


def compare_forests(
    trial: Trial, n_trees: int, members: int, run_depth: int, **settings
) -> tuple[DataFrame, DataFrame]:
    """Each kind of forest as one fit and as sub-forests side by side: two result tables."""
    spark = trial.train.sparkSession
    data = binned_rows(trial.train, trial.features, max_bins=trial.max_bins)
    single, several = [], []
    try:
        for lib, (kind, _) in FORESTS.items():
            more = compared_changes(lib, run_depth) | settings
            start = time.perf_counter()
            one = fit_forest(data, kind, n_trees, run_depth, trial.seed, **more)
            middle = time.perf_counter()
            parts = fit_members(data, kind, n_trees, members, run_depth, trial.seed, **more)
            end = time.perf_counter()
            for rows, took, scored, trees in (
                (single, middle - start, score(trial.test, one), len(one.trees)),
                (several, end - middle, score_members(trial.test, parts),
                 sum(len(p.trees) for p in parts)),
            ):
                with scratch(spark):
                    quality = evaluate(scored).first()
                rows.append((lib, round(took, 2), quality["accuracy"], quality["auc"], trees))
    finally:
        data.close()
    schema = "lib string, time double, accuracy double, auc double, trees int"
    return spark.createDataFrame(single, schema), spark.createDataFrame(several, schema)
