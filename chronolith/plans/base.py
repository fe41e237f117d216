"""What the queries share: cleaned tables, fixed parameters and the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import complexity as cx
from chronolith.operators import history as hs
from chronolith.operators import patterns as pt
from chronolith.options import DEFAULT, Options
from chronolith.session import spread
from chronolith.sources.tables import changed_files, commits, once, table

ALL = Options(patterns="all")
REMOTE = "git@github.com:lantern/lantern-core.git"

AUTHORS = ("author", "author_email", "authored_date", "insertions", "deletions")


def author_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits(spark, sf_dir, *AUTHORS)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = commits(spark, sf_dir, "author", "authored_date", "committed_date")
    return hs.file_history(dated, changed_files(spark, sf_dir))


def findings_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of the files that the given findings changed, by these findings alone."""
    rows = table(spark, sf_dir, "findings").where("commit_id is not null")
    dated = once(rows, "author", "date").select("commit_id", "author", F.col("date").alias("authored_date"), F.col("date").alias("committed_date"))
    files = rows.select("commit_id", F.explode("files_changed").alias("path")).where("path is not null").distinct()
    return hs.file_history(dated, files)


def matched_commits(spark: SparkSession, sf_dir: str, options: Options = ALL) -> DataFrame:
    """Each commit with a match once, with its hits: matched in the scan, before anything but the hits is shuffled."""
    columns = ("message", "author", "authored_date")
    rows = spread(table(spark, sf_dir, "commits").where("commit_id is not null").select("commit_id", *columns))
    return once(pt.matched(rows, options), *columns, "hits")


def findings(spark: SparkSession, sf_dir: str, options: Options = ALL) -> DataFrame:
    return pt.findings(matched_commits(spark, sf_dir, options), changed_files(spark, sf_dir), options)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.complexity(spread(cx.analysed(table(spark, sf_dir, "source_files"))))


def _quoted(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def _sql_patterns() -> str:
    rows = [(p.ord, *map(_quoted, (p.name, f"(?i){p.regex}", p.severity, p.category, p.cwe, p.description, "|".join(p.examples)))) for p in pt.builtin_patterns()]
    return ", ".join(f"({', '.join(map(str, r))})" for r in rows)


def sql_examples() -> str:
    return ", ".join(f"({p.ord}, {_quoted(e)})" for p in pt.builtin_patterns() for e in p.examples)


#: commits once, files once, patterns, and the matches of all of them
SQL = f"""
with c as (select commit_id, max(message) as message, max(author) as author, max(author_email) as author_email,
  max(authored_date) as authored_date, max(committed_date) as committed_date, max(insertions) as insertions, max(deletions) as deletions
  from commits where commit_id is not null group by commit_id),
f as (select distinct commit_id, path from file_changes where commit_id is not null and path is not null),
nf as (select commit_id, count(*) as n from f group by commit_id),
p(ord, name, pattern, severity, category, cwe, description, examples) as (values {_sql_patterns()}),
m as (select c.commit_id, p.ord, p.name, p.severity, p.category, regexp_extract(c.message, p.pattern, 0) as matched_text,
  'CVE-' || regexp_extract(c.message, '(?i)\\bcve[-\\s]?(\\d{{4}}[-\\s]?\\d{{4,}})\\b', 1) as cve
  from c join p on regexp_matches(c.message, p.pattern)),
w as (select *, case severity when 'Critical' then 9 when 'High' then 7 when 'Medium' then 5 when 'Low' then 3 else 1 end as weight from m),
r as (select w.commit_id, list(name order by ord) as names, list(ord order by ord) as ords,
  case when bool_or(name = 'CVE Reference') then max(case when name = 'CVE Reference' then cve end) end as cve,
  least(sum(weight) * sqrt(coalesce(any_value(nf.n), 0)) * case when bool_or(name = 'CVE Reference') then 2.0 else 1.0 end, 10.0) as risk
  from w left join nf on w.commit_id = nf.commit_id group by w.commit_id),
h as (select path, count(*) as total_changes, count(distinct author) as authors, min(authored_date) as first_commit, max(authored_date) as last_commit,
  arg_max(f.commit_id, (coalesce(committed_date, to_timestamp(0)), f.commit_id)) as recent_commit,
  arg_min(f.commit_id, (coalesce(committed_date, to_timestamp(0)), f.commit_id)) as ref_recent_commit
  from f join c on f.commit_id = c.commit_id group by path),
x as (select path, regexp_extract(path, '([^/]*)$', 1) as base from h),
e as (select path, case when regexp_matches(base, '^.+\\.[^.]*$') then regexp_extract(base, '^.+\\.([^.]*)$', 1) end as ext from x)
"""

#: authors of the files that the given findings changed
SQL_FINDINGS = """
with f as (select distinct commit_id, author, unnest(files_changed) as path from findings where commit_id is not null),
h as (select path, count(distinct author) as authors, min(author) as author from f where path is not null group by path),
x as (select path, regexp_extract(path, '([^/]*)$', 1) as base from h),
e as (select path, case when regexp_matches(base, '^.+\\.[^.]*$') then lower(regexp_extract(base, '^.+\\.([^.]*)$', 1)) end as ext from x)
"""

STAMP = "strftime({0} at time zone 'UTC', '%Y-%m-%d %H:%M:%S')"


def stamp(column: str) -> str:
    return STAMP.format(column)


__all__ = ["ALL", "AUTHORS", "DEFAULT", "REMOTE", "SQL", "SQL_FINDINGS", "author_commits", "findings", "findings_history", "history", "metrics", "stamp"]
