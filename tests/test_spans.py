from datetime import datetime, timedelta

import __spark_entry__ as contract
import pytest
from pyspark.sql import functions as F

from boostlab.streaming import spans

DAY = datetime(2024, 1, 1)


def _rows(spark, samples, runs):
    return (
        spark.createDataFrame([(DAY + timedelta(seconds=s), d, u) for s, d, u in samples],
                              "ts timestamp, device_id int, util int"),
        spark.createDataFrame(
            [(r, *(None if x is None else DAY + timedelta(seconds=x) for x in (a, b)))
             for r, a, b in runs], "run string, start timestamp, stop timestamp"))


SAMPLES = [(0, 0, 10), (5, 0, 20), (5, 1, 7), (60, 0, 30), (61, 0, 99), (200, 1, None), (200, 0, 50)]
RUNS = [("both ends", 5, 60), ("long", 0, 500), ("instant", 61, 61), ("before", -100, -1),
        ("backwards", 60, 5), ("open", 0, None), ("null only", 150, 199)]
WANT = {("both ends", 0, 25.0, 30), ("both ends", 1, 7.0, 7), ("long", 0, 41.8, 99),
        ("long", 1, 7.0, 7), ("instant", 0, 99.0, 99)}


@pytest.mark.parametrize("seconds", [1, 7, 3600])
def test_samples_of_a_span(spark, seconds):
    samples, runs = _rows(spark, SAMPLES, RUNS)
    assert {tuple(r) for r in spans.run_stats(samples, runs, seconds=seconds).collect()} == WANT


def _streams(spark, tmp_path, files):
    """Both tables as streams of one file a batch, dealt to files by ``files``."""
    tables = _rows(spark, SAMPLES, RUNS)
    streams = []
    for name, df in zip(("samples", "runs"), tables):
        rows, folder = df.collect(), str(tmp_path / name)
        for k in range(files):
            spark.createDataFrame(rows[k::files], df.schema).coalesce(1).write.mode(
                "append").parquet(folder)
        streams.append(spark.readStream.schema(df.schema).option(
            "maxFilesPerTrigger", 1).parquet(folder))
    return streams


@pytest.mark.parametrize("files", [1, 3])
def test_the_stream_agrees_with_the_batch(spark, tmp_path, files):
    got = spans.drain_runs(spark, *_streams(spark, tmp_path, files), late="1 hour")
    assert {tuple(r) for r in got.collect()} == WANT


def test_a_run_too_long_for_the_stream_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="a run longer than"):
        spans.drain_runs(spark, *_streams(spark, tmp_path, 1), longest="1 minute").collect()


def test_no_runs_or_no_samples(spark):
    samples, runs = _rows(spark, SAMPLES, RUNS)
    assert spans.run_stats(samples, runs.limit(0)).count() == 0
    assert spans.run_stats(samples.limit(0), runs).count() == 0


def test_a_hot_run_is_summed_on_the_map_side(spark):
    """No run meets all its samples in one task: the plan sums before it shuffles by run."""
    samples, runs = _rows(spark, SAMPLES, RUNS)
    plan = spans.run_stats(samples, runs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_bucket") > 0 and "Aggregate [run" in plan
    wide = spans.cut_spans(runs.filter("run = 'long'"), 60)
    assert wide.count() == 9 and wide.agg(F.countDistinct("_bucket")).first()[0] == 9


def test_query_agrees_with_the_stream(spark, sf_dir):
    queries = contract.queries()
    batch, stream = (queries[n](spark, sf_dir) for n in ("run_device_stats", "run_device_stream"))
    assert batch.exceptAll(stream).isEmpty() and stream.exceptAll(batch).isEmpty()
    assert not batch.isEmpty()
