"""The canonical tables and their cleaned views.

Commits and their files can be delivered more than once; every query counts a commit once per ``commit_id`` and a
changed file once per ``(commit_id, path)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a directory; Catalyst prunes its columns and pushes filters down to it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """Each ``commit_id`` once with the given columns; ``max`` over their struct keeps the choice the same on every run."""
    picked = rows.groupBy("commit_id").agg(F.max(F.struct(*columns)).alias("_row"))
    return picked.select("commit_id", *(F.col("_row")[c].alias(c) for c in columns))


def commits(spark: SparkSession, sf_dir: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Each commit once, with ``commit_id`` and the given columns; take only those that are needed, they are shuffled.

    Redelivered rows are unchanged, so any row of a commit stands for it. ``where`` filters rows before they are shuffled. A null ``commit_id`` is
    no commit and is left out.
    """
    rows = table(spark, sf_dir, "commits").where(F.col("commit_id").isNotNull())
    if where is not None:
        rows = rows.where(where)
    if not columns:
        return rows.select("commit_id").distinct()
    return once(rows, *columns)


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ``(commit_id, path)`` once; rows without a commit or path are left out."""
    rows = table(spark, sf_dir, "file_changes").select("commit_id", "path")
    return rows.dropna(how="any").distinct()
