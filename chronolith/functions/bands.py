"""Bands of scores and counts. The names and limits are fixed values of the report format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score from which a band begins.
SEVERITY = {"critical": 8, "high": 6, "medium": 4, "low": 2}
RISK = {"critical": 8, "high": 6, "medium": 4}
# Count up to which a band goes.
COMMITS = {"commits-0": 0, "commits-1": 2, "commits-2": 5, "commits-3": 10, "commits-4": 20}
CHURN = {"churn-low": 5, "churn-medium": 15, "churn-high": 30}


def _from(value: Column, limits: dict[str, int], rest: str) -> Column:
    """The first band whose limit the value reaches; a null value is in the last band."""
    return F.coalesce(*(F.when(value >= least, name) for name, least in limits.items()), F.lit(rest))


def _upto(value: Column, limits: dict[str, int | Column], rest: str) -> Column:
    return F.coalesce(*(F.when(value <= most, name) for name, most in limits.items()), F.lit(rest))


def severity_text(score: Column) -> Column:
    return _from(score, SEVERITY, "info")


def severity_class(score: Column) -> Column:
    return F.concat(F.lit("severity-"), severity_text(score))


def risk_class(score: Column) -> Column:
    return F.concat(F.lit("risk-"), _from(score, RISK, "low"))


def commit_band(count: Column) -> Column:
    return _upto(count, COMMITS, "commits-high")


def churn_band(count: Column) -> Column:
    return _upto(count, CHURN, "churn-critical")


def fifth(most: Column, k: int) -> Column:
    """``k`` fifths of a count, rounded down."""
    return F.floor(most * k / 5).cast("long")


def heat_band(count: Column, most: Column) -> Column:
    """The band of a count in fifths of the largest count."""
    limits = {"commits-0": F.lit(0)} | {f"commits-{k}": fifth(most, k) for k in (1, 2, 3, 4)}
    return _upto(count, limits, "commits-high")
