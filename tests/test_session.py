import os
from types import SimpleNamespace

import pytest

from outcomelens.session import scratch_path, settle, shared_dir


def session(configured=None, current=None, master="spark://host"):
    """The three things the folder choice looks at."""
    made = []
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(
            master=master, getCheckpointDir=lambda: current or (made or [None])[-1], setCheckpointDir=made.append))


def test_the_configured_folder_wins():
    assert shared_dir(session(configured="hdfs:///shared", current="/elsewhere")) == "hdfs:///shared"
    assert shared_dir(session(current="hdfs:///set")) == "hdfs:///set"
    assert scratch_path(session(configured="hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session())


def test_a_local_session_gets_its_own_folder():
    local = session(master="local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_settle_cuts_the_plan(spark):
    settled = settle(spark.range(10).repartition(3).selectExpr("id * 2 AS x"))
    plan = settled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and sorted(r["x"] for r in settled.collect()) == list(range(0, 20, 2))


def test_scratch_data_is_removed(spark, tmp_path):
    from outcomelens import session

    kept, session._made[:] = session._made[:], []
    try:
        path = scratch_path(spark, "short-lived")
        spark.range(5).write.parquet(path)
        assert spark.read.parquet(path).count() == 5
        session.drop_scratch()
        assert not session._made and not os.path.exists(path.removeprefix("file:"))
    finally:
        session._made[:] = kept
