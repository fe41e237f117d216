"""Session and checkpoint helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(threads: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE); on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{threads}]")
        .appName("chronolith")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        # checkpoints that nothing refers to any more are removed
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder.

    The folder is read from ``spark.checkpoint.dir``. Only a local session may do without it and gets a temporary
    folder; on a cluster such a folder would lie on one machine, so the setting is asked for. Lost executors do not
    lose checkpointed data.

    What Spark takes over from the plan before a checkpoint is dropped: its size, often far too small, which would
    broadcast large tables, and its constraints, which double with every round of an iteration.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="chronolith-checkpoint-"))
    saved = df.checkpoint()
    rows = saved._jdf.queryExecution().toRdd()
    plain = saved.sparkSession._jsparkSession.internalCreateDataFrame(rows, saved._jdf.schema(), False)
    return DataFrame(plain, saved.sparkSession)


def input_chunks(df: DataFrame) -> int:
    """The partitions that the plan of ``df`` has, without running any of it: input splits, or those of its last shuffle."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() != "AdaptiveSparkPlan":
        return max(df._jdf.queryExecution().toRdd().getNumPartitions(), 1)
    # a plan with shuffles runs adaptively; a union of several can have more partitions than it tells
    last = plan.inputPlan().outputPartitioning().numPartitions()
    return max(last, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores if it has fewer splits; for rows that cost far more to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_chunks(df) < cores else df
