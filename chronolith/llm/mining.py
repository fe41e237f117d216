"""Queries of the problems on items and keys: pairs of paths (1), top findings of a path (5), authors (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.paths import second
from chronolith.llm.cooccurrence import cooccurring
from chronolith.llm.names import entity_pairs, link_names
from chronolith.llm.topn import top_n
from chronolith.sources.tables import table


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paths changed together, with their counts, lift and log-likelihood ratio."""
    found = cooccurring(table(spark, sf_dir, "file_changes"), "commit_id", "path")
    return found.select(
        F.col("item_a").alias("path_a"),
        F.col("item_b").alias("path_b"),
        "n_ab",
        "n_a",
        "n_b",
        F.round("lift", 6).alias("lift"),
        F.round("llr", 6).alias("llr"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pairs(spark, sf_dir).select("path_a", "path_b")


def _top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "findings").where("risk_score is not null and commit_id is not null")
    once = rows.groupBy("commit_id").agg(F.max(F.struct("risk_score", "date", "files_changed")).alias("f"))
    exploded = once.select("commit_id", "f.risk_score", "f.date", F.explode(F.array_distinct("f.files_changed")).alias("path"))
    order = [F.desc_nulls_last("risk_score"), F.desc_nulls_last("date")]
    return top_n(exploded.where("path is not null"), ["path"], order, "commit_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_findings(spark, sf_dir).select("path", "commit_id")


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three findings of highest risk of every path, with rank and score."""
    return _top_findings(spark, sf_dir).select("path", "rank", "commit_id", "risk_score", second(F.col("date")).alias("date"))


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every author row that belongs with another one."""
    return link_names(table(spark, sf_dir, "authors"), "author_id", "name", "email")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(p7_entities(spark, sf_dir), "author_id")


_PAIRS = """
with f as (select distinct commit_id, path from file_changes where commit_id is not null and path is not null),
p as (select path, count(*) as n from f group by path),
t as (select cast(count(distinct commit_id) as double) as n from f),
g as (select a.path as path_a, b.path as path_b, count(*) as n_ab
  from f a join f b on a.commit_id = b.commit_id and a.path < b.path group by 1, 2 having count(*) >= 10),
k as (select g.*, x.n as n_a, y.n as n_b, t.n as n from g join p x on x.path = path_a join p y on y.path = path_b cross join t),
r as (select * from k where n_ab * n >= 4.0 * n_a * n_b)
"""
_LLR = """2 * (n_ab * ln(n_ab * n / (n_a::double * n_b))
  + case when n_a > n_ab then (n_a - n_ab) * ln((n_a - n_ab) * n / (n_a * (n - n_b))) else 0 end
  + case when n_b > n_ab then (n_b - n_ab) * ln((n_b - n_ab) * n / (n_b * (n - n_a))) else 0 end
  + case when n - n_a - n_b + n_ab > 0
    then (n - n_a - n_b + n_ab) * ln((n - n_a - n_b + n_ab) * n / ((n - n_a) * (n - n_b))) else 0 end)"""
_TOP = """
with f as (select distinct commit_id, risk_score, date, files_changed from findings where risk_score is not null and commit_id is not null),
e as (select distinct commit_id, risk_score, date, unnest(files_changed) as path from f),
r as (select *, row_number() over (partition by path order by risk_score desc, date desc nulls last, commit_id) as rank
  from e where path is not null)
"""

QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p5_found": p5_found, "p5_ranked": p5_ranked, "p7_found": p7_found, "p7_entities": p7_entities}
ORACLES = {
    "p1_found": _PAIRS + "select path_a, path_b from r",
    "p1_pairs": _PAIRS
    + f"select path_a, path_b, n_ab, n_a, n_b, round(n_ab * n / (n_a::double * n_b), 6) as lift, round({_LLR}, 6) as llr from r",
    "p5_found": _TOP + "select path, commit_id from r where rank <= 3",
    "p5_ranked": _TOP + "select path, cast(rank as int) as rank, commit_id, risk_score, strftime(date at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as date from r where rank <= 3",
}
