"""Pairs inside blocks, whatever the size of a block: a large one is cut into parts, and every part meets every other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.sizes import HOT, small_side
from chronolith.session import cut

#: rows of one part of a block
PART = 1_000
#: one row in so many is looked at to find the large blocks
SAMPLED = 16


def large_blocks(index: DataFrame, block: str, id: str, part: int = PART) -> DataFrame:
    """``block, parts`` of the blocks with clearly more than ``part`` rows, checkpointed.

    Rows are picked by a hash, one in ``SAMPLED``, and counted; a block missed by chance is only worked off in one
    piece, so no result depends on the selection. Small parts are counted in full.
    """
    every = SAMPLED if part >= 20 * SAMPLED else 1
    seen = index.where(F.pmod(F.xxhash64(id, block), F.lit(every)) == 0) if every > 1 else index
    counts = seen.groupBy(block).agg((F.count(F.lit(1)) * every).alias("_n")).where(F.col("_n") > part)
    return cut(counts.select(block, "_n", F.ceil(F.col("_n") / part).cast("int").alias("_parts")))


def _with_parts(rows: DataFrame, block: str, large: DataFrame) -> DataFrame:
    """``rows`` with the number of parts of their blocks, 1 for those that are not large; no block is shuffled as a whole."""
    parts = large.select(block, "_parts")
    near = small_side(parts)
    if near is not parts:
        return rows.join(near, block, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    # of more large blocks than can be broadcast, those of more than one row in HOT are HOT at most
    least = large.agg(F.sum("_n")).first()[0] / HOT
    hot = F.broadcast(large.where(F.col("_n") > least).select(block, "_parts"))
    rest = rows.join(hot.select(block), block, "left_anti").join(large.where(F.col("_n") <= least).select(block, "_parts").hint("merge"), block, "left")
    return rows.join(hot, block).unionByName(rest.withColumn("_parts", F.coalesce("_parts", F.lit(1))))


def cells(left: DataFrame, right: DataFrame, block: str, large: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """``left`` and ``right`` joined on ``block``, large blocks part by part; columns other than ``block`` must differ."""
    sides = []
    for rows, key, own, other in ((left, left_id, "_i", "_j"), (right, right_id, "_j", "_i")):
        split = _with_parts(rows, block, large).withColumn(own, F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
        sides.append(split.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"))
    return sides[0].join(sides[1].hint("merge"), [block, "_i", "_j"]).drop("_i", "_j")


def block_pairs(index: DataFrame, block: str, id: str, large: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``a, b`` (``a < b``) of rows of one block, with ``carry`` columns of both (``_a``, ``_b``); once a shared block.

    ``large`` comes from ``large_blocks``. A pair in parts i <= j meets in cell (i, j) only, so no task gets more
    than one part of each side, and a row is sent once for every part of its block.
    """
    split = _with_parts(index.select(block, id, *carry), block, large).withColumn("_own", F.pmod(F.xxhash64(id), F.col("_parts")).cast("int"))
    first = split.select(
        block, F.col(id).alias("a"), *(F.col(c).alias(f"{c}_a") for c in carry), F.col("_own").alias("_i"),
        F.explode(F.sequence(F.col("_own"), F.col("_parts") - 1)).alias("_j"),
    )
    second = split.select(
        block, F.col(id).alias("b"), *(F.col(c).alias(f"{c}_b") for c in carry), F.col("_own").alias("_j"),
        F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i"),
    )
    met = first.join(second.hint("merge"), [block, "_i", "_j"]).where("a < b or (_i < _j and a > b)")
    swap = lambda c, d: F.when(F.col("a") < F.col("b"), F.col(c)).otherwise(F.col(d))
    return met.select(
        swap("a", "b").alias("a"), swap("b", "a").alias("b"),
        *(swap(f"{c}_{s}", f"{c}_{t}").alias(f"{c}_{s}") for c in carry for s, t in ("ab", "ba")),
    )
