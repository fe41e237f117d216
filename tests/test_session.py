"""Checkpoints lie where all executors can see them."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from chronolith.session import cut


class _Rows:
    """What ``cut`` asks of a DataFrame, with a session of a given master and setting."""

    def __init__(self, master, folder=None):
        self.set = None
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: self.set, setCheckpointDir=self._keep)
        self.sparkSession = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: folder))

    def _keep(self, folder):
        self.set = folder

    def checkpoint(self):
        raise _Set(self.set)


class _Set(Exception):
    """The checkpoint folder that was set."""


@pytest.mark.parametrize(
    ("master", "folder", "want"),
    [("spark://host:7077", "hdfs://host/shared", "hdfs://host/shared"), ("local[2]", None, "chronolith-checkpoint-"), ("local-cluster[3,2,1024]", "/shared", "/shared")],
)
def test_the_shared_folder_is_used(master, folder, want):
    with pytest.raises(_Set, match=want):
        cut(_Rows(master, folder))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        cut(_Rows("spark://host:7077"))


def test_lineage_is_cut(spark):
    rows = cut(spark.range(5).selectExpr("id * 2 as x"))
    assert sorted(r.x for r in rows.collect()) == [0, 2, 4, 6, 8]
    assert "ExistingRDD" in rows._jdf.queryExecution().executedPlan().toString()


def test_nothing_is_taken_over_from_before_a_checkpoint(spark):
    """Neither a size too small to be true, which would broadcast a table, nor constraints, which grow with every round."""
    rows = cut(spark.range(5).selectExpr("id as x", "id + 1 as y").where("x < y"))
    plan = rows._jdf.queryExecution().optimizedPlan()
    assert plan.stats().sizeInBytes() > 1 << 40 and plan.constraints().isEmpty()
    other = cut(spark.range(3).toDF("x"))
    assert "SortMergeJoin" in rows.join(other, "x")._jdf.queryExecution().executedPlan().toString()
    assert rows.join(other, "x").count() == 3
