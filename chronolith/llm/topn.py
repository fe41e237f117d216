"""Problem 5: the top N items of every group, in two salted stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: list[str], order: list[Column], identifier: str, n: int = 3, salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` and then ``identifier`` ascending, with their ``rank``.

    Stage one hashes the identifier into ``salts`` subgroups, ranks inside each and keeps ``n``; stage two ranks the
    at most ``n * salts`` survivors of a group. A group of millions of rows is thus ranked by many tasks, and the
    result is exact. Spark drops rows beyond ``n`` already before each shuffle (window group limit). Equal rows
    differ by nothing, so either may be kept. Null groups form a group; where nulls sort is up to ``order``. Groups
    with fewer than ``n`` rows keep them all; an empty table gives no rows. A column called ``rank`` is not allowed.
    """
    if "rank" in df.columns:
        raise ValueError("the input already has a column called rank")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(identifier), F.lit(salts)))
    by = [*order, F.col(identifier).asc()]
    first = Window.partitionBy(*group, "_salt").orderBy(*by)
    last = Window.partitionBy(*group).orderBy(*by)
    kept = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).drop("rank", "_salt")
    return kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)
