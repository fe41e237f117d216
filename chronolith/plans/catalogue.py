"""All core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.plans import code, findings, history, hotkeys, report, roundtrip

MODULES = [findings, history, code, report, hotkeys, roundtrip]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.f5_findings(spark, sf_dir).orderBy("risk_score", "commit_id", ascending=[False, True])
