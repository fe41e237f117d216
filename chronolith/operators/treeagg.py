"""Per-key results when a few keys hold most of the rows.

The aggregation is a tree. Every input partition is one chunk and is combined where it lies (Spark's partial hash
aggregation). The partial states are then merged in rounds, each round joining ``fan_in`` neighbouring chunks of a
key, so no task ever receives the partials of all chunks for a hot key: after ``log_fan_in(chunks)`` rounds one state
per key is left. The number of chunks is that of the plan's partitions, so a scan of many splits gets more rounds.
States are counts, sums, minima and maxima, whose size does not depend on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.session import input_chunks

MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
INIT = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def rounds_for(chunks: int, fan_in: int) -> int:
    """Rounds after which one state is left of so many chunks."""
    rounds = 1
    while fan_in**rounds < chunks:
        rounds += 1
    return rounds


def tree_aggregate(
    df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str | Column]], fan_in: int = 8, chunks: int | None = None
) -> DataFrame:
    """Aggregate ``df`` by ``keys`` through logarithmic fan-in rounds.

    ``aggregates`` maps an output name to (``count`` | ``sum`` | ``min`` | ``max``, column). Null keys form one group
    of their own, as in ``groupBy``; null values are ignored; an empty table gives no rows. Other columns of ``df``
    are not looked at, whatever their names; an output may not be called like a key. ``chunks`` is the number of input
    chunks, by default that of the plan's partitions.
    """
    if clash := set(keys) & set(aggregates):
        raise ValueError(f"outputs named like keys: {sorted(clash)}")
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    chunks = input_chunks(df) if chunks is None else chunks
    rounds = rounds_for(chunks, fan_in)
    names = [f"k{i}" for i in range(len(keys))]
    states = df.select(
        *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)),
        *((F.col(c) if isinstance(c, str) else c).alias(f"v{i}") for i, (_, c) in enumerate(aggregates.values())),
        # numbers beyond what the plan told fold into those below, so the last round never gets more than it should
        F.expr(f"int(pmod(spark_partition_id(), {chunks})) div {fan_in}").cast("int").alias("chunk"),
    )
    step = INIT
    for done in range(rounds):
        columns = [step[kind](f"v{i}").alias(f"v{i}") for i, (kind, _) in enumerate(aggregates.values())]
        last = done == rounds - 1
        states = states.groupBy(*names, *([] if last else ["chunk"])).agg(*columns)
        if not last:
            states = states.withColumn("chunk", (F.col("chunk") / fan_in).cast("int"))
        step = MERGE
    return states.select(
        *(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)),
        *(F.col(f"v{i}").alias(out) for i, out in enumerate(aggregates)),
    )


def hot_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Rows per non-null key with the key's share of them: ``key, n, share, hot``; ``hot`` means at least ``share``.

    An empty table gives no rows.
    """
    counts = tree_aggregate(df.where(F.col(key).isNotNull()), [key], {"n": ("count", F.lit(1))})
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.select(
        key,
        "n",
        (F.col("n") / total).alias("share"),
        (F.col("n").cast("double") >= F.lit(share) * total).alias("hot"),
    )
