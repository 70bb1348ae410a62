import os
import re
import time
from datetime import datetime

import pytest

from boostlab.operators import boosting
from boostlab.plans import reports, sweep
from boostlab.registry.trees import _trial
from boostlab.sources import results


def test_selection_follows_its_flags():
    assert len(sweep.Selection().names()) == 13
    assert sweep.Selection(gpus=1).names() == [
        "xgboost_cpu", "xgboost_1gpu", "catboost_cpu", "catboost_1gpu", "lightgbm_cpu",
        "lightgbm_1gpu", "rf_sklearn", "rf_xgboost", "rf_lightgbm"]
    assert "xgboost_2gpu_dask" in sweep.Selection(gpus=2).names()
    assert sweep.Selection(skip_cpu=True, skip_multi_gpu=True, skip_catboost=True).names() == [
        "xgboost_1gpu", "lightgbm_1gpu"]
    assert sorted(sweep.SHORT_NAMES.values()) == sorted(sweep.Selection().names())


def test_a_failing_configuration_does_not_stop_the_sweep(spark, sf_dir):
    def run(trial, name, rounds):
        if name.startswith("catboost"):
            raise RuntimeError("no device")
        return {"time_seconds": 1.0, "accuracy": 0.5, "auc": 0.5, "trees": rounds}

    chosen = sweep.Selection(skip_1gpu=True, skip_multi_gpu=True, skip_rf=True)
    rows = sweep.run_sweep(_trial(spark, sf_dir, 3), chosen, [2, 3], run).orderBy("iterations", "pos")
    assert [(r["iterations"], r["name"], r["status"]) for r in rows.collect()] == [
        (n, f"{lib}_cpu", "RuntimeError: no device" if lib == "catboost" else "ok")
        for n in (2, 3) for lib in ("xgboost", "catboost", "lightgbm")]


def test_unknown_names_are_errors(spark, sf_dir):
    with pytest.raises(ValueError):
        sweep.run_single(_trial(spark, sf_dir, 3), "xgb-tpu", [1])
    with pytest.raises(ValueError):
        sweep.fit_config(_trial(spark, sf_dir, 3), "adaboost_cpu", 1)


def test_speedup_edge_rows(spark):
    rows = [(1, 0, "a_cpu", 4.0), (1, 1, "a_1gpu", 2.0), (1, 2, "b_1gpu", 2.0),
            (1, 3, "c_cpu", 0.0), (1, 4, "c_1gpu", 2.0), (1, 5, "rf_x", 1.0), (1, 6, "a_0gpu", 0.0)]
    runs = spark.createDataFrame(
        [(*r, 0.5, 0.5) for r in rows],
        "iterations int, pos int, name string, time_seconds double, accuracy double, auc double")
    shown = {r["name"]: r["speedup_text"] for r in reports.speedup_vs_cpu(runs).collect()}
    assert shown == {"a_cpu": "-", "a_1gpu": "2.0x", "b_1gpu": "-", "c_cpu": "-", "c_1gpu": "-",
                     "rf_x": "-", "a_0gpu": "-"}


def test_no_crossover(spark):
    sizes = spark.createDataFrame([("s", 1, 1.0, 2.0), ("m", 2, 1.0, 1.0)],
                                  "name string, n_samples long, t_single double, t_dist double")
    assert reports.crossover(sizes).first()["message"] == "single is faster for all sizes"


def test_a_sweep_bins_once_and_its_document_agrees_with_itself(spark, sf_dir, tmp_path, monkeypatch):
    made = []
    real = boosting.make_blocks
    monkeypatch.setattr(boosting, "make_blocks", lambda *a: made.append(1) or real(*a))
    chosen = sweep.Selection(skip_1gpu=True, skip_multi_gpu=True)
    path = sweep.sweep_document(_trial(spark, sf_dir, 2), chosen, [1], str(tmp_path))
    assert len(made) == 2  # training rows and test rows, for all configurations
    assert re.fullmatch(r"benchmark_results_[0-9]{8}_[0-9]{6}[.]json", path.split("/")[-1])
    flat = results.flatten_results(results.read_documents(spark, path))
    compared = reports.compare_runs(flat, flat, 0.0).collect()
    assert len(compared) == 6 and {r["status"] for r in compared} == {"same"}


CHOSEN = sweep.Selection(skip_1gpu=True, skip_multi_gpu=True, skip_rf=True)


def _quick(trial, name, rounds):
    return {"time_seconds": 1.0, "accuracy": 0.5, "auc": None, "trees": rounds}


def test_a_killed_sweep_goes_on(spark, sf_dir, tmp_path):
    """Killed midway, then with a failing run, then whole: finished runs are never repeated."""
    trial, log, begun = _trial(spark, sf_dir, 2), str(tmp_path / "log"), []

    def run(trial, name, rounds):
        begun.append((rounds, name))
        if len(begun) == 3:
            raise KeyboardInterrupt
        if len(begun) == 5:
            raise RuntimeError("lost")
        return _quick(trial, name, rounds)

    with pytest.raises(KeyboardInterrupt):
        sweep.run_sweep(trial, CHOSEN, [1, 2], run, log=log)
    second = sweep.run_sweep(trial, CHOSEN, [1, 2], run, log=log).collect()
    assert [r["status"] for r in second] == ["ok"] * 3 + ["RuntimeError: lost"] + ["ok"] * 2
    third = sweep.run_sweep(trial, CHOSEN, [1, 2], run, log=log).collect()
    names = ["xgboost_cpu", "catboost_cpu", "lightgbm_cpu"]
    keys = [(n, name) for n in (1, 2) for name in names]
    assert [(r["iterations"], r["name"]) for r in third] == keys
    assert {r["status"] for r in third} == {"ok"} and all(r["start"] <= r["stop"] for r in third)
    assert begun == [*keys[:3], *keys[2:], keys[3]]
    assert sweep.run_sweep(trial, CHOSEN, [1, 2], run, log=log).collect() == third
    assert len(begun) == 8


def test_a_log_belongs_to_one_trial(spark, sf_dir, tmp_path):
    log = str(tmp_path / "log")
    sweep.run_sweep(_trial(spark, sf_dir, 2), CHOSEN, [1], _quick, log=log)
    with pytest.raises(ValueError):
        sweep.run_sweep(_trial(spark, sf_dir, 3), CHOSEN, [1], _quick, log=log)


def test_a_run_over_its_time_is_cancelled(spark, sf_dir, tmp_path):
    def run(trial, name, rounds):
        if name.startswith("catboost"):
            spark.range(8, numPartitions=8).mapInPandas(slow, "id long").count()
        return _quick(trial, name, rounds)

    def slow(batches):
        import time

        for batch in batches:
            time.sleep(60)
            yield batch

    start = time.monotonic()
    log = str(tmp_path / "log")
    rows = sweep.run_sweep(
        _trial(spark, sf_dir, 2), CHOSEN, [1], run, log=log, limit_seconds=4).collect()
    assert [r["status"] for r in rows] == ["ok", "timeout", "ok"]
    assert time.monotonic() - start < 45
    again = sweep.run_sweep(_trial(spark, sf_dir, 2), CHOSEN, [1], run, log=log).collect()
    assert again == rows  # a timeout is a result


def test_a_document_holds_the_statistics_of_each_run(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    trial = _trial(spark, sf_dir, 2)
    now = datetime.now()
    samples = spark.range(0, 7200).select(
        (F.lit(now) + F.make_dt_interval(secs=F.col("id") / 4)).alias("ts"),
        (F.col("id") % 2).cast("int").alias("device_id"),
        (F.col("id") % 2 * 50 + 7).cast("int").alias("util"))

    def run(trial, name, rounds):
        time.sleep(2)
        return _quick(trial, name, rounds)

    path = sweep.sweep_document(trial, CHOSEN, [1], str(tmp_path), run, samples)
    assert os.path.isfile(path)
    flat = results.flatten_results(results.read_documents(spark, path)).collect()
    want = {"gpu0_avg_util": 7.0, "gpu0_max_util": 7.0, "gpu1_avg_util": 57.0,
            "gpu1_max_util": 57.0}
    assert len(flat) == 3 and all(r["gpu_stats"] == want for r in flat)


def test_hardware_of_tool_output(spark):
    from boostlab.sources import hardware

    texts = {"processor": "Model name:  Chip 9000\nCPU(s):  8\nNUMA node0 CPU(s): 0-7\n",
             "devices": "Card A, 24570 MiB, 550.1\nCard B, 81920 MiB, 550.1\n",
             "toolkit": "compiler\nCuda compilation tools, release 12.4, V12\n"}
    row = spark.range(1).select(*[c.alias(k) for k, c in hardware.columns(spark, texts).items()])
    found = row.first().asDict(recursive=True)
    assert found["cpu_model"] == "Chip 9000" and found["gpu_count"] == 2
    assert found["gpus"][1] == {"name": "Card B", "memory_mb": 81920, "driver": "550.1"}
    assert "release 12.4" in found["cuda_version"]
    none = spark.range(1).select(*[
        c.alias(k) for k, c in hardware.columns(spark, dict.fromkeys(texts, "")).items()]).first()
    assert none["gpus"] == [] and none["cpu_model"] is None and none["cuda_version"] is None
