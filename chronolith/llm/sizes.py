"""Broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: a key of more than one of so many rows is hot; there are never more hot keys than this
HOT = 10_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows and ``most`` bytes, else ``df`` itself (a shuffled join).

    ``df`` should be checkpointed: it is measured, up to one row more than the limit. Numbers count as 8 bytes.
    """
    texts = [F.coalesce(F.octet_length(F.to_json(F.struct(f.name)) if f.dataType.typeName() != "string" else F.col(f.name)), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "array", "map", "struct")]
    size = sum(texts, F.lit(8 * len(df.columns)))
    seen = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["rows"] <= limit and seen["bytes"] <= most else df


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts`` on ``key``, whatever share of the rows a key holds.

    ``facts`` has every key once and in ``weight`` how many of the ``total`` rows have it. Keys of more than one row in
    ``HOT`` are broadcast: their weights add up to ``total`` at most, so there are at most ``HOT`` of them. The others
    are joined by a shuffle in which no key is large.
    """
    hot = F.col(weight) > total / HOT
    near = rows.join(F.broadcast(facts.where(hot)), key)
    return near.unionByName(rows.join(facts.where(~hot).hint("merge"), key))
