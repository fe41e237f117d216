"""Problem 9: mixing sources to target weights, by capped water-filling.

A source can give at most ``max_repeats`` times its own size. Where a target needs more, the source is clamped there
and what is missing goes to the other sources in proportion to their shares, again until nothing more is clamped. What
a source gives is then whole passes over all its rows and one fractional pass over a seeded selection of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: a mixture names its sources by hand; a table of more rows than this is no table of targets
MOST_SOURCES = 10_000
SLOTS = 65_536


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def water_fill(available: dict[str, int], targets: list[Target], total: float | None = None) -> dict[str, float]:
    """Size that each source gives to a mixture of size ``total``.

    Without ``total`` it is the largest at which every source that has anything reaches its share. If the caps do not
    allow ``total``, every source gives all it may. A source without rows gives nothing; its share goes to the others.
    """
    cap = {t.source: float(available.get(t.source, 0) * max(t.max_repeats, 0)) for t in targets}
    share = {t.source: t.share for t in targets if t.share > 0 and cap[t.source] > 0}
    given = dict.fromkeys(cap, 0.0)
    if not share:
        return given
    if total is None:
        whole = sum(share.values())
        total = min(cap[s] * whole / w for s, w in share.items())
    left = float(total)
    while share:
        whole = sum(share.values())
        full = [s for s, w in share.items() if left * w / whole >= cap[s]]
        if not full:
            return given | {s: left * w / whole for s, w in share.items()}
        for s in full:
            given[s] = cap[s]
            left -= cap[s]
            del share[s]
    return given


def wanted(targets: DataFrame) -> list[Target]:
    """The named targets; a null share or number of repeats counts as 0."""
    rows = targets.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    return [Target(r.source, r.target_share or 0.0, r.max_repeats or 0) for r in rows if r.source is not None]


def available(sized: DataFrame, targets: list[Target], source: str, size: str) -> dict[str, int]:
    """The size that each target has; targets without rows are left out."""
    named = sized.where((F.col(size) > 0) & F.col(source).isin([t.source for t in targets]))
    return {r[source]: r["size"] for r in named.groupBy(source).agg(F.sum(size).alias("size")).collect()}


def capacity(sizes: dict[str, int], targets: list[Target]) -> int:
    """The size of a mixture in which every source with a share gives all it may."""
    return sum(sizes.get(t.source, 0) * max(t.max_repeats, 0) for t in targets if t.share > 0)


def mix(sized: DataFrame, targets: DataFrame, key: str, source: str, size: str, fill: float | None = None, seed: int = 17):
    """Rows of ``sized`` with ``repeats``, the times each is used, so that sources reach their shares of the size.

    ``targets`` has source, target_share and max_repeats. Returns ``key, source, size, repeats`` of the rows used at
    least once. Rows of size 0 or null, and rows whose source is null or has no target, are never used. The
    fractional pass takes rows in the order of a seeded hash of the key while they fit: the order's 65,536 slots are
    summed first, and only the slot in which a source's share ends is looked at row by row, so that no source is ever
    ranked as a whole. Shares are thus met to within one row. ``fill`` asks for a mixture of that share of the
    ``capacity``, in which some sources are clamped; without it the mixture is the largest that meets all shares.
    Pass ``sized`` checkpointed, it is read several times.
    """
    targets = wanted(targets)
    named = sized.where((F.col(size) > 0) & F.col(source).isin([t.source for t in targets]))
    named = named.select(key, source, size, F.xxhash64(F.lit(seed), key).alias("draw"))
    named = named.withColumn("slot", F.shiftrightunsigned("draw", 48))
    sizes = available(sized, targets, source, size)
    given = water_fill(sizes, targets, None if fill is None else fill * capacity(sizes, targets))
    plan = [(s, int(given[s] / n + 1e-9), max(0.0, given[s] - int(given[s] / n + 1e-9) * n)) for s, n in sizes.items()]
    spark = sized.sparkSession
    passes = spark.createDataFrame(plan, "source string, whole int, budget double")
    slots = named.groupBy(source, "slot").agg(F.sum(size).alias("size"))
    upto = F.sum("size").over(Window.partitionBy(source).orderBy("slot"))
    slots = slots.withColumn("upto", upto).withColumnRenamed(source, "source").join(F.broadcast(passes), "source")
    # the first slot that does not fit as a whole, and the size before it
    ends = slots.where("upto > budget").groupBy("source").agg(F.min(F.struct("slot", "upto", "size")).alias("e"))
    ends = ends.select("source", F.col("e.slot").alias("end"), (F.col("e.upto") - F.col("e.size")).alias("before"))
    plan_rows = passes.join(ends, "source", "left").collect()
    plan_schema = "_source string, whole int, budget double, end long, before double"
    ending = spark.createDataFrame(
        [(r.source, r.whole, r.budget, SLOTS if r.end is None else r.end, float(r.before or 0)) for r in plan_rows], plan_schema
    )
    joined = named.join(F.broadcast(ending), F.col(source) == F.col("_source"))
    last = joined.where("slot = end")
    running = F.sum(size).over(Window.partitionBy(source).orderBy("draw", key).rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("extra", (F.col("before") + running <= F.col("budget")).cast("int"))
    rest = joined.where("slot <> end").withColumn("extra", (F.col("slot") < F.col("end")).cast("int"))
    used = rest.unionByName(last).withColumn("repeats", F.col("whole") + F.col("extra"))
    return used.where("repeats > 0").select(key, source, size, "repeats")


def reached(used: DataFrame, targets: DataFrame, source: str, size: str) -> DataFrame:
    """Per target its share, the rows used, the size reached and the share reached; 0 where nothing was used."""
    sums = used.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("rows_used"),
        F.sum(F.col(size) * F.col("repeats")).alias("size_used"),
        F.max("repeats").alias("most_repeats"),
    )
    out = targets.join(sums, "source", "left").fillna(0, ["rows_used", "size_used", "most_repeats"])
    whole = F.sum("size_used").over(Window.partitionBy())
    return out.withColumn("reached_share", F.when(whole > 0, F.col("size_used") / whole).otherwise(F.lit(0.0)))
