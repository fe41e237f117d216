"""Authors, files and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.paths import second
from chronolith.operators import history as hs
from chronolith.options import DEFAULT, Options
from chronolith.plans.base import SQL, SQL_FINDINGS, author_commits, findings_history, history, stamp
from chronolith.sources.tables import changed_files, commits, table


def s4_newest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hs.newest_commits(commits(spark, sf_dir, "committed_date"), Options(max_commits=200))
    return rows.select("commit_id", second(F.col("committed_date")).alias("committed_date"))


def s5_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit once; a null message is an empty one."""
    rows = commits(spark, sf_dir, "message", "author", "author_email", "authored_date")
    return rows.select("commit_id", F.coalesce("message", F.lit("")).alias("message"), "author", "author_email", second(F.col("authored_date")).alias("authored_date"))


def j1_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit with its number of files, 0 for none."""
    files = changed_files(spark, sf_dir).groupBy("commit_id").agg(F.count(F.lit(1)).alias("files"))
    return commits(spark, sf_dir).join(files, "commit_id", "left").fillna(0, ["files"])


def w5_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "file_changes").dropna(how="any").groupBy("commit_id", "path").agg(F.min("ord").alias("ord"))
    return hs.capped_files(rows, Options(files_per_commit=5))


def a1_repo_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hs.repository_totals(author_commits(spark, sf_dir), changed_files(spark, sf_dir))
    return rows.select("total_commits", "total_authors", "total_files", second(F.col("first_commit")).alias("first_commit"), second(F.col("last_commit")).alias("last_commit"))


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.author_stats(author_commits(spark, sf_dir), changed_files(spark, sf_dir))


def _author_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "name", "email", "commits", "lines_added", "lines_removed", "files_touched",
        second(F.col("first_commit")).alias("first_commit"), second(F.col("last_commit")).alias("last_commit"),
    )


def a2_author_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _author_rows(_authors(spark, sf_dir))


def t1_top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _author_rows(hs.top_contributors(_authors(spark, sf_dir)))


def _files(rows: DataFrame) -> DataFrame:
    return rows.select(
        "path", "total_changes", "authors", second(F.col("first_commit")).alias("first_commit"), second(F.col("last_commit")).alias("last_commit")
    )


def a3_file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(history(spark, sf_dir))


def a3_author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.author_names(commits(spark, sf_dir, "author"), changed_files(spark, sf_dir))


def f1_single_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.single_author_files(history(spark, sf_dir)).select("path", F.col("any_author").alias("author"))


def f1_single_author_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the given findings changed and that one author alone did."""
    return hs.single_author_files(findings_history(spark, sf_dir)).select("path", F.col("any_author").alias("author"))


def a3_file_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit list of every file, as rows."""
    rows = hs.file_commits(commits(spark, sf_dir, "committed_date"), changed_files(spark, sf_dir))
    return rows.select("path", "commit_id", second(F.col("at")).alias("at"))


def f2_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.stale_files(history(spark, sf_dir)).select("path", second(F.col("last_commit")).alias("last_commit"))


def w3_high_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hs.high_churn_files(history(spark, sf_dir)).select("path", "total_changes")


def w4_recent_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("path", "recent_commit", "ref_recent_commit")


_AUTHORS = f"""select a.*, coalesce(t.n, 0) as files_touched from (
  select coalesce(author, '') as name, coalesce(author_email, '') as email, count(*) as commits, cast(coalesce(sum(insertions), 0) as bigint) as lines_added,
  cast(coalesce(sum(deletions), 0) as bigint) as lines_removed, {stamp("min(authored_date)")} as first_commit, {stamp("max(authored_date)")} as last_commit
  from c group by 1, 2) a left join (select coalesce(author, '') as name, coalesce(author_email, '') as email, count(distinct path) as n
  from c join f on c.commit_id = f.commit_id group by 1, 2) t on a.name = t.name and a.email = t.email"""
_LIMIT = f"timestamptz '{DEFAULT.as_of}+00' - interval 365 days"

QUERIES = {
    "s4_newest_commits": s4_newest_commits, "s5_commits": s5_commits, "j1_commit_files": j1_commit_files, "w5_file_cap": w5_file_cap,
    "a1_repo_totals": a1_repo_totals, "a2_author_stats": a2_author_stats, "t1_top_contributors": t1_top_contributors,
    "a3_file_history": a3_file_history, "a3_author_names": a3_author_names, "f1_single_author": f1_single_author, "f2_stale": f2_stale,
    "f1_single_author_findings": f1_single_author_findings, "a3_file_commits": a3_file_commits,
    "w3_high_churn": w3_high_churn, "w4_recent_commit": w4_recent_commit,
}
ORACLES = {
    "s4_newest_commits": SQL + f"select commit_id, {stamp('committed_date')} as committed_date from c order by c.committed_date desc nulls last, commit_id limit 200",
    "s5_commits": SQL + f"select commit_id, coalesce(message, '') as message, author, author_email, {stamp('authored_date')} as authored_date from c",
    "j1_commit_files": SQL + "select c.commit_id, coalesce(nf.n, 0) as files from c left join nf on c.commit_id = nf.commit_id",
    "w5_file_cap": """select commit_id, path from (select commit_id, path, row_number() over (partition by commit_id order by ord, path) as k
  from (select commit_id, path, min(ord) as ord from file_changes where commit_id is not null and path is not null and ord is not null group by 1, 2)) where k <= 5 and path <> ''""",
    "a1_repo_totals": SQL + f"""select count(*) as total_commits, count(distinct coalesce(author, '') || ':' || coalesce(author_email, '')) as total_authors,
  (select count(distinct path) from f) as total_files, {stamp("min(authored_date)")} as first_commit, {stamp("max(authored_date)")} as last_commit from c""",
    "a2_author_stats": SQL + _AUTHORS,
    "t1_top_contributors": SQL + f"select * from ({_AUTHORS}) order by commits desc, name, email limit 5",
    "a3_file_history": SQL + f"select path, total_changes, authors, {stamp('first_commit')} as first_commit, {stamp('last_commit')} as last_commit from h",
    "a3_author_names": SQL + "select distinct path, author from f join c on f.commit_id = c.commit_id",
    "f1_single_author": SQL + "select path, (select min(author) from f join c on f.commit_id = c.commit_id where f.path = h.path) as author from h where authors = 1",
    "f1_single_author_findings": SQL_FINDINGS + "select path, author from h where authors = 1",
    "a3_file_commits": SQL + f"select path, f.commit_id, {stamp('committed_date')} as at from f join c on f.commit_id = c.commit_id",
    "f2_stale": SQL + f"select path, {stamp('last_commit')} as last_commit from h where h.last_commit < {_LIMIT}",
    "w3_high_churn": SQL + "select path, total_changes from (select *, row_number() over (order by total_changes desc, path) as k, count(*) over () as n from h) where k <= greatest(n // 10, 1)",
    "w4_recent_commit": SQL + "select path, recent_commit, ref_recent_commit from h",
}
