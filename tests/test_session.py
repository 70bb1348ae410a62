"""Folders of a run: who makes them, and when they go."""

import os

import pyarrow as pa

import __spark_entry__ as contract
from boostlab import session


def held(spark):
    home = session._home(spark).removeprefix("file:")
    return set(os.listdir(home)) if os.path.isdir(home) else set()


def test_scratch_deletes_what_was_made_inside(spark):
    before = held(spark)
    outer, path = session.settled_alone(
        spark, lambda: session.settled(session.settled(spark.range(5)).filter("id > 1")))
    assert held(spark) - before == {os.path.basename(path)}
    assert outer.count() == 3
    session.drop_dir(spark, path)
    assert held(spark) == before


def test_scratch_may_be_nested_and_survives_errors(spark):
    before = held(spark)
    try:
        with session.scratch(spark):
            session.settled(spark.range(2))
            with session.scratch(spark):
                session.settled(spark.range(3))
            assert len(held(spark) - before) == 1
            raise ValueError
    except ValueError:
        pass
    assert held(spark) == before


def test_reports_leave_no_folder(spark, sf_dir):
    before = held(spark)
    for name in ("held_out_quality", "boost_stump", "forest_bootstrap_nodes"):
        assert contract.queries()[name](spark, sf_dir).count() > 0
    assert held(spark) == before


def test_blocks_reach_python_in_small_batches(spark):
    """A worker holds few blocks at once, however many its task has."""
    from boostlab.session import BATCH_BYTES, steady_session

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

    steady = steady_session(spark)
    blocks = steady.range(0, 40, 1, 1).selectExpr("CAST(repeat('x', 1000000) AS BINARY) AS bins")
    got = [r["size"] for r in blocks.mapInArrow(sizes, "size long").collect()]
    assert sum(got) >= 40_000_000 and max(got) <= BATCH_BYTES + 1_100_000
