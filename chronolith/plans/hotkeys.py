"""Problem 4: per-path and per-name results although a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.paths import second
from chronolith.operators.treeagg import hot_keys, tree_aggregate
from chronolith.sources.tables import changed_files, commits

HOT_SHARE = 0.015


def _keyed(counts: DataFrame, field: str, key: str) -> DataFrame:
    return counts.select(F.lit(field).alias("field"), F.col(key).alias("key_value"), "n", "share", "hot")


def _key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = hot_keys(changed_files(spark, sf_dir), "path", HOT_SHARE)
    names = hot_keys(commits(spark, sf_dir, "author"), "author", HOT_SHARE)
    return _keyed(paths, "path", "path").unionByName(_keyed(names, "name", "author"))


def p4_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct commits of every path and of every author name, with the share and whether the key is hot."""
    return _key_counts(spark, sf_dir).select("field", "key_value", "n", F.round("share", 9).alias("share"), "hot")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths and names that hold at least 1.5 % of the rows."""
    return _key_counts(spark, sf_dir).where("hot").select("field", "key_value")


def p4_name_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per author name: commits, lines added and removed, first and last commit."""
    rows = commits(spark, sf_dir, "author", "insertions", "deletions", "authored_date")
    sums = tree_aggregate(
        rows.where(F.col("author").isNotNull()),
        ["author"],
        {
            "commits": ("count", F.lit(1)),
            "lines_added": ("sum", "insertions"),
            "lines_removed": ("sum", "deletions"),
            "first_commit": ("min", "authored_date"),
            "last_commit": ("max", "authored_date"),
        },
    )
    return sums.withColumns({c: second(F.col(c)) for c in ("first_commit", "last_commit")})


_COUNTS = """
with c as (select commit_id, max(author) as author from commits where commit_id is not null group by commit_id),
f as (select distinct commit_id, path from file_changes where commit_id is not null and path is not null),
k as (select 'path' as field, path as key_value, count(*) as n from f group by path
  union all select 'name', author, count(*) from c where author is not null group by author),
t as (select field, key_value, n, n / sum(n) over (partition by field) as share from k)
"""

QUERIES = {"p4_found": p4_found, "p4_key_counts": p4_key_counts, "p4_name_stats": p4_name_stats}
ORACLES = {
    "p4_found": _COUNTS + "select field, key_value from t where share >= 0.015",
    "p4_key_counts": _COUNTS + "select field, key_value, n, round(share, 9) as share, share >= 0.015 as hot from t",
    "p4_name_stats": """select author, count(*) as commits, cast(sum(insertions) as bigint) as lines_added,
  cast(sum(deletions) as bigint) as lines_removed, strftime(min(authored_date) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as first_commit,
  strftime(max(authored_date) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as last_commit
  from (select distinct * from commits) where author is not null group by author""",
}
