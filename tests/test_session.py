"""Where intermediate tables may go, and when rows are spread."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from pagelens import session


def fake(master: str, root: str | None = None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: root), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_path(fake(master), "x")
    assert session.scratch_path(fake(master, "hdfs://shared/"), "x").startswith("hdfs://shared/x-")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_may_use_its_own(master):
    path = session.scratch_path(fake(master), "x")
    os.makedirs(path)
    assert os.path.dirname(path) == os.path.dirname(session.scratch_path(fake(master), "y"))
    session.clear_scratch(fake(master))
    assert not os.path.exists(os.path.dirname(path))


def test_only_small_input_is_spread(spark, plan_of):
    small = spark.range(10)
    assert "RoundRobin" in plan_of(session.spread(small)) and "RoundRobin" not in plan_of(session.spread(small, small_mb=0))
    assert "RoundRobinPartitioning(3)" in plan_of(session.spread(small, 3))
