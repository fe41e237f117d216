"""Dependency manifests at the root of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.paths import occurrences
from chronolith.operators.complexity import lines

# Manifest names; only the first two are counted.
NAMES = ("Cargo.toml", "package.json", "requirements.txt", "pom.xml", "build.gradle", "go.mod", "Gemfile")


def cargo_entries(content: Column) -> Column:
    """Lines with an equals sign that do not begin with ``#``, as they stand (an indented comment counts)."""
    return F.size(F.filter(lines(content), lambda x: F.contains(x, F.lit("=")) & ~F.startswith(x, F.lit("#")))).cast("long")


def npm_entries(content: Column) -> Column:
    """Half of the quoted keys."""
    return F.floor(occurrences(content, '":') / 2).cast("long")


def dependency_counts(files: DataFrame) -> DataFrame:
    """``manifest, dependencies`` of the countable manifests in ``files`` (path, content). A null content is empty."""
    text = F.coalesce("content", F.lit(""))
    counted = F.when(F.col("path") == NAMES[0], cargo_entries(text)).otherwise(npm_entries(text))
    return files.where(F.col("path").isin(*NAMES[:2])).select(F.col("path").alias("manifest"), counted.alias("dependencies"))


def dependency_analysis(counts: DataFrame) -> DataFrame:
    """One row: the sum of the dependencies; outdated and vulnerable ones and licence issues need a registry and stay empty."""
    none = F.array().cast("array<string>")
    total = F.coalesce(F.sum("dependencies"), F.lit(0))
    return counts.agg(total.alias("total_dependencies")).select(
        "total_dependencies", none.alias("outdated_dependencies"), none.alias("vulnerable_dependencies"), none.alias("license_issues")
    )


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of the manifests that lie directly in a folder; content that is not UTF-8 is null."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{','.join(NAMES)}}}").load(root)
    text = F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("path"), text.alias("content"))
