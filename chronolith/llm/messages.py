"""Queries of the problems on commit messages: near-duplicates (3) and personal information (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.neardup import expand, named_classes, near_duplicates
from chronolith.llm.pii import personal_items, redacted
from chronolith.session import spread
from chronolith.sources.tables import commits, table


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # redelivered commits are unchanged: a key counts once per different text
    rows = spread(table(spark, sf_dir, "commits").where("commit_id is not null").select("commit_id", "message"))
    return near_duplicates(rows, "commit_id", "message", words=3, threshold=0.5, min_words=20)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of commits whose messages have a similarity of at least 0.5 on three-word sequences."""
    return expand(*_near(spark, sf_dir), "commit_id")


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit with a message long enough: its class of equal messages, their number, and the similar classes' number."""
    return named_classes(*_near(spark, sf_dir), "commit_id")[0]


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar classes of messages, named by their smallest commit."""
    return named_classes(*_near(spark, sf_dir), "commit_id")[1].withColumn("similarity", F.round("similarity", 9))


PERSONAL = {"message": "text", "author_email": "address"}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal items of every commit's message and address field."""
    # redelivered commits are unchanged: their items fall together when the items are made distinct
    return personal_items(spread(table(spark, sf_dir, "commits").where("commit_id is not null").select("commit_id", *PERSONAL)), "commit_id", PERSONAL)


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and address fields with typed placeholders."""
    return redacted(commits(spark, sf_dir, *PERSONAL), "commit_id", PERSONAL)


_WORDS = """
with c as (select distinct commit_id, regexp_extract_all(lower(message), '[a-z0-9]+') as w from commits where message is not null and commit_id is not null),
s as (select commit_id, list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) as s
  from c where len(w) >= 20),
k as (select s, min(commit_id) as class, count(*) as copies from s group by s),
d as (select class, len(s) as n, unnest(s) as t from k),
p as (select a.class as class_a, b.class as class_b, count(*) / (any_value(a.n + b.n) - count(*)) as similarity
  from d a join d b on a.t = b.t and a.class < b.class group by a.class, b.class having 2 * count(*) >= any_value(a.n + b.n) - count(*)),
m as (select commit_id, class, copies from s join k using (s)),
l as (select class, count(*) as links from (select class_a as class from p union all select class_b from p) group by class),
e as (select x.commit_id as x, y.commit_id as y from m x join m y on x.class = y.class and x.commit_id < y.commit_id
  union all select x.commit_id, y.commit_id from p join m x on x.class = class_a join m y on y.class = class_b)
"""

QUERIES = {"p3_found": p3_found, "p3_members": p3_members, "p3_links": p3_links, "p6_found": p6_found, "p6_redacted": p6_redacted}
ORACLES = {
    "p3_found": _WORDS + "select least(x, y) as commit_id_a, greatest(x, y) as commit_id_b from e",
    "p3_members": _WORDS + "select commit_id, class, copies, coalesce(links, 0) as links from m left join l using (class)",
    "p3_links": _WORDS + "select class_a, class_b, round(similarity, 9) as similarity from p",
}
