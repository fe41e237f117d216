"""Scalar risks of a repository; each is one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.options import DEFAULT, Options


def _share(part, whole):
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def git_risk(history: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """2 x single-author share + 1.5 x stale share + 1 x high-churn share; 0 without files."""
    # one pass: how many files are kept as high-churn is known from how many there are
    n = F.count(F.lit(1))
    limit = F.lit(options.as_of).cast("timestamp") - F.expr(f"INTERVAL {options.stale_days} DAYS")
    counts = history.agg(
        n.alias("files"),
        F.count_if(F.col("authors") == 1).alias("single"),
        F.count_if(F.col("last_commit") < limit).alias("stale"),
        F.least(F.greatest(F.floor(n / 10), F.lit(1)), n).alias("churn"),
    )
    share = {name: _share(F.col(name), F.col("files")) for name in ("single", "stale", "churn")}
    return counts.select((2.0 * share["single"] + 1.5 * share["stale"] + share["churn"]).alias("git_risk"))


def code_risk(metrics: DataFrame, outdated: int = 0, vulnerable: int = 0) -> DataFrame:
    """2 x share of files above 10 + up to 1 for outdated dependencies + 0.5 for each vulnerable one."""
    counts = metrics.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("cyclomatic_complexity") > 10).alias("high"))
    return counts.select((2.0 * _share(F.col("high"), F.col("files")) + min(0.1 * outdated, 1.0) + 0.5 * vulnerable).alias("code_risk"))


def vulnerability_risk(findings: DataFrame) -> DataFrame:
    return findings.agg(F.least(F.coalesce(F.sum(F.col("risk_score") / 10), F.lit(0.0)), F.lit(5.0)).alias("vulnerability_risk"))


def overall_risk(git: DataFrame, code: DataFrame | None, vulnerability: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The sum, 10 at most, and its whole percent. Without code metrics ``compat_nan`` makes it 10."""
    parts = git.withColumn("vulnerability_risk", vulnerability.scalar())
    if code is None:
        parts = parts.withColumn("code_risk", F.lit(10.0 if options.compat_nan else 0.0))
    else:
        parts = parts.withColumn("code_risk", code.scalar())
    total = F.least(F.col("git_risk") + F.col("code_risk") + F.col("vulnerability_risk"), F.lit(10.0))
    return parts.select(
        "git_risk", "code_risk", "vulnerability_risk", total.alias("overall_risk"), (F.round(total * 10, 9)).cast("int").alias("risk_percent")
    )
