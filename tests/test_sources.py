import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from boostlab import session
from boostlab.sources import handover, results, texts


def samples(spark, text):
    return texts.parse_samples(spark.createDataFrame([(1, text)], "ts int, text string")).drop("ts")


def test_samples_skip_short_lines_and_spoiled_polls(spark):
    kept = samples(spark, "0, 12, 5, 9\n\n1, 3\n2,4,5,6,more\n")
    assert sorted(kept.collect()) == [(0, 12, 5, 9), (2, 4, 5, 6)]
    assert samples(spark, "0, 12, 5, 9\n1, [N/A], 5, 9").count() == 0
    assert samples(spark, "0, 1, 1, 1\n0, 2, 2, 2").collect() == [(0, 2, 2, 2)]
    assert samples(spark, "").count() == 0


def test_inventory_memory_that_is_no_number(spark):
    lines = [("NVIDIA L4, 24570 MiB, 570.1",), ("Odd, [N/A], 1",), ("short, 1 MiB",)]
    parsed = texts.parse_inventory(spark.createDataFrame(lines, "line string"))
    assert sorted(parsed.collect()) == [("NVIDIA L4", 24570, "570.1"), ("Odd", 0, "1")]


def test_key_values(spark):
    lines = ["Model name:   Xeon: 8558", "CPU(s):   48", "On-line CPU(s) list: 0-47",
             "NUMA node0 CPU(s): 0-47", "Vendor: x"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    assert sorted(texts.parse_key_values(df).collect()) == [("cpu_count", "48"), ("cpu_model", "Xeon")]


def test_result_line_is_the_first_one(spark):
    rows = [(1, 0, "noise"), (1, 2, "RESULT:time=2,accuracy=0.5,auc=0.6"),
            (1, 1, "RESULT:time=1.5,accuracy=0.25,auc=0.75"), (2, 0, "x RESULT:time=1")]
    df = spark.createDataFrame(rows, "doc int, no int, line string")
    found = texts.parse_result_lines(df, "doc", "no").orderBy("doc").collect()
    assert found == [(1, True, 1.5, 0.25, 0.75), (2, False, None, None, None)]


def document():
    run = {"time_seconds": 1.5, "accuracy": 0.9, "auc": 0.95}
    return {
        "hardware": {"cpu_count": 8, "gpus": [{"name": "a", "memory_mb": 1, "driver": "d"}]},
        "parameters": {"samples": 10, "iterations": [10, 20]},
        "benchmarks": [
            {"iterations": 10, "results": {
                "xgboost_cpu": {**run, "gpu_stats": {}},
                "xgboost_1gpu": {**run, "gpu_stats": {"gpu0_avg_util": 86.3, "gpu0_max_util": 100,
                                                      "gpu1_avg_util": 1.0, "gpu1_max_util": 2}}}},
            {"iterations": 20, "results": {"xgboost_cpu": {**run, "gpu_stats": {}}}},
        ],
    }


def test_result_document_round_trip(spark, tmp_path):
    path = tmp_path / "results.json"
    path.write_text(json.dumps(document(), indent=2))
    read = results.read_documents(spark, str(path))
    flat = results.flatten_results(read)
    assert flat.count() == 3
    out = str(tmp_path / "copy")
    results.write_document(read, out)
    assert results.read_documents(spark, out).collect() == read.collect()
    devices = results.device_stats_long(flat)
    assert devices.filter("device_id = 0").collect() == [(10, "xgboost_1gpu", 0, 86.3, 100)]
    assert devices.filter("device_id is null").count() == 2


def test_nest_then_flatten_gives_the_rows_back(spark):
    rows = [(10, 1, "b", 1.0, 0.5, 0.6, {}), (10, 0, "a", 2.0, 0.5, 0.6, {"gpu0_avg_util": 1.0}),
            (5, 0, "a", 3.0, 0.5, None, {})]
    runs = spark.createDataFrame(
        rows, "iterations int, pos int, name string, time_seconds double, accuracy double, "
        "auc double, gpu_stats map<string,double>")
    nested = results.nest_results(runs)
    assert [b["iterations"] for b in nested.first()["benchmarks"]] == [5, 10]
    flat = results.flatten_results(nested)
    assert sorted(map(str, flat.collect())) == sorted(map(str, runs.drop("pos").collect()))


def _handed(spark, path):
    df = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("row_id"), (F.col("id") / 7).alias("f0"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("f 1"), F.lit("x").alias("_seal"))
    assert handover.hand_over(df, path).exceptAll(df).isEmpty()
    return sorted(glob.glob(f"{path}/rows/*.parquet"))


def test_hand_over_of_no_rows(spark):
    none = spark.range(0).withColumnRenamed("id", "row_id")
    assert handover.hand_over(none).count() == 0


def _faults(spark, path):
    with pytest.raises(handover.BrokenHandOver):
        handover.receive(spark, path)
    return {(r["fault"], tuple(r["columns"] or ())) for r in handover.faults(spark, path).collect()}


def test_a_changed_value_is_found(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    first, *_ = _handed(spark, str(tmp_path / "d"))
    rows = pq.read_table(first)
    values = rows["f0"].to_pylist()
    values[7] += 1e-9
    pq.write_table(rows.set_column(1, "f0", pa.array(values)), first)
    os.remove(os.path.join(os.path.dirname(first), f".{os.path.basename(first)}.crc"))
    assert _faults(spark, str(tmp_path / "d")) == {("content", ("f0",))}


def test_exchanged_values_are_found(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    first, *_ = _handed(spark, str(tmp_path / "d"))
    rows = pq.read_table(first)
    values = rows["f0"].to_pylist()
    values[7], values[8] = values[8], values[7]
    pq.write_table(rows.set_column(1, "f0", pa.array(values)), first)
    os.remove(os.path.join(os.path.dirname(first), f".{os.path.basename(first)}.crc"))
    assert _faults(spark, str(tmp_path / "d")) == {("content", ())}


def test_missing_and_added_files_are_found(spark, tmp_path):
    import shutil

    first, second, *_ = _handed(spark, str(tmp_path / "d"))
    os.rename(first, str(tmp_path / "away"))
    shutil.copy(second, second.replace("part-", "part-9"))
    assert _faults(spark, str(tmp_path / "d")) == {("missing", ()), ("added", ())}


def test_forests_score_whatever_hangs_on_the_session(spark, sf_dir):
    """An observation stays with the session, and a forest's summary holds the session."""
    from pyspark.sql import Observation

    import __spark_entry__ as contract

    queries = contract.queries()
    queries["dataset_roundtrip"](spark, sf_dir).count()
    seen = Observation()
    spark.range(10).observe(seen, F.count("*").alias("n")).count()
    assert seen.get == {"n": 10}
    for name in ("rf_mllib", "forest_members_mllib"):
        assert queries[name](spark, sf_dir).count() == 1


class FakeSession:
    """A session of some master, with or without the setting."""

    def __init__(self, master, setting):
        self.sparkContext = self
        self.conf = self
        self.master, self.setting = master, setting

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting or default

    def getCheckpointDir(self):
        return None


def test_shared_dir_is_read_from_the_session():
    assert session.shared_dir(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        session.shared_dir(FakeSession("yarn", None))


def test_run_folders_are_separate_and_can_be_dropped(spark):
    one, two = session.run_dir(spark, "x"), session.run_dir(spark, "x")
    spark.range(3).write.parquet(one)
    spark.range(4).write.parquet(two)
    session.drop_dir(spark, one)
    assert spark.read.parquet(two).count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(one)
