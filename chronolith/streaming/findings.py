"""Streams of commits: findings as they arrive, and commits per author and window.

Matching and scoring a commit needs nothing but the commit, so the batch operators run on a stream as they are. Commits
that are delivered again are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators import patterns as pt
from chronolith.options import DEFAULT, Options


def once(commits: DataFrame, late: str = "30 days") -> DataFrame:
    """Each commit once, as long as its repetitions come within ``late`` by commit time."""
    return commits.withWatermark("committed_date", late).dropDuplicatesWithinWatermark(["commit_id"])


def streaming_findings(commits: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Findings of a stream of commits that carry their files in ``files_changed`` (an array, null for none)."""
    chosen = pt.pattern_set(options.patterns, options)
    rows = commits.where(pt.any_match(F.col("message"), chosen)).withColumn("matches", pt.matches(F.col("message"), chosen))
    files = F.coalesce(F.size(F.array_distinct("files_changed")), F.lit(0))
    return rows.select(
        "commit_id",
        "author",
        "committed_date",
        F.transform("matches", lambda m: m["pattern_name"]).alias("patterns_matched"),
        pt.risk_score(F.col("matches"), F.greatest(files, F.lit(0)), options).alias("risk_score"),
    )


def commits_per_window(commits: DataFrame, window: str = "7 days", late: str | None = "30 days") -> DataFrame:
    """Commits per author and tumbling window of commit time; what is later than ``late`` is left out.

    Pass ``late`` None for a stream that already has a watermark, such as the result of ``once``.
    """
    rows = commits.withWatermark("committed_date", late) if late else commits
    counts = rows.groupBy(F.window("committed_date", window), "author").agg(F.count(F.lit(1)).alias("commits"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "author", "commits")
