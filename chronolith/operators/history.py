"""History of authors and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.paths import author_key
from chronolith.options import DEFAULT, Options
from chronolith.session import cut


def newest_commits(commits: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The newest commits by commit time, at most ``max_commits`` (a top-k, not a sort of everything)."""
    return commits.orderBy(F.desc_nulls_last("committed_date"), "commit_id").limit(options.max_commits)


def capped_files(files: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The first files of each commit by ``ord``; empty names are dropped after counting."""
    place = Window.partitionBy("commit_id").orderBy("ord", "path")
    kept = files.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= options.files_per_commit)
    return kept.where("path <> ''").select("commit_id", "path").distinct()


def repository_totals(commits: DataFrame, files: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """One row: commits, authors, files, first and last commit; without commits ``as_of`` and the epoch."""
    head = commits.agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.count_distinct(author_key(F.col("author"), F.col("author_email"))).alias("total_authors"),
        F.coalesce(F.min("authored_date"), F.lit(options.as_of).cast("timestamp")).alias("first_commit"),
        F.coalesce(F.max("authored_date"), F.timestamp_seconds(F.lit(0))).alias("last_commit"),
    )
    paths = files.agg(F.count_distinct("path").alias("total_files")).scalar()
    return head.withColumn("total_files", paths)


def author_stats(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per name and address: commits, lines, dates and distinct files. Null names and addresses count as empty ones.

    Lines are summed on commits alone and files are counted on their own, so no commit is counted once per file.
    """
    named = commits.select(
        "commit_id", F.coalesce("author", F.lit("")).alias("name"), F.coalesce("author_email", F.lit("")).alias("email"),
        "insertions", "deletions", "authored_date",
    )
    sums = named.groupBy("name", "email").agg(
        F.count("commit_id").alias("commits"),
        F.sum("insertions").alias("lines_added"),
        F.sum("deletions").alias("lines_removed"),
        F.min("authored_date").alias("first_commit"),
        F.max("authored_date").alias("last_commit"),
    )
    touched = files.join(named.select("commit_id", "name", "email"), "commit_id").select("name", "email", "path").distinct()
    touched = touched.groupBy("name", "email").agg(F.count("path").alias("files_touched"))
    return sums.join(touched, ["name", "email"], "left").fillna(0, ["files_touched", "lines_added", "lines_removed"])


def file_history(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per path: changes, distinct author names, first and last change, and the newest and the oldest commit.

    Kept to states of fixed size; ``author_names`` and ``file_commits`` give the lists where they are wanted.
    """
    dated = files.join(commits.select("commit_id", "author", "authored_date", "committed_date"), "commit_id")
    stamp = F.struct(F.coalesce("committed_date", F.timestamp_seconds(F.lit(0))).alias("at"), "commit_id")
    base = dated.groupBy("path").agg(
        F.count("commit_id").alias("total_changes"),
        F.min("authored_date").alias("first_commit"),
        F.max("authored_date").alias("last_commit"),
        F.max(stamp).alias("newest"),
        F.min(stamp).alias("oldest"),
    )
    people = dated.select("path", "author").distinct().groupBy("path").agg(F.count("author").alias("authors"), F.min("author").alias("any_author"))
    return base.join(people, "path").select(
        "path", "total_changes", "authors", "any_author", "first_commit", "last_commit",
        F.col("newest.commit_id").alias("recent_commit"), F.col("oldest.commit_id").alias("ref_recent_commit"),
    )


def author_names(commits: DataFrame, files: DataFrame) -> DataFrame:
    """``path, author`` pairs, each once: the set of names of a file, as rows (a hot file's set has no limit)."""
    return files.join(commits.select("commit_id", "author"), "commit_id").select("path", "author").distinct()


def single_author_files(history: DataFrame) -> DataFrame:
    return history.where("authors = 1")


def stale_files(history: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Files last changed more than ``stale_days`` before ``as_of``."""
    limit = F.lit(options.as_of).cast("timestamp") - F.expr(f"INTERVAL {options.stale_days} DAYS")
    return history.where(F.col("last_commit") < limit)


def file_commits(commits: DataFrame, files: DataFrame) -> DataFrame:
    """``path, commit_id, at``: the commit list of every file, as rows (a hot file's list has no limit); order by ``at`` to read one."""
    return files.join(commits.select("commit_id", F.col("committed_date").alias("at")), "commit_id").select("path", "commit_id", "at")


def high_churn_files(history: DataFrame) -> DataFrame:
    """The most changed tenth of the files, one at least; ties by path.

    How many files have each number of changes says where the tenth ends: all files above that number are kept, and
    only those of exactly that number are ordered, to keep the first of them.
    """
    history = cut(history)
    counts = history.groupBy("total_changes").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are different numbers of changes: their sum bounds them
    bars = counts.agg(F.sort_array(F.collect_list(F.struct("total_changes", "n")), asc=False).alias("bars"), F.sum("n").alias("files"))
    walk = """aggregate(bars, struct(greatest(files div 10, 1L) as left, cast(null as bigint) as least),
      (s, x) -> if(s.least is not null, s, if(x.n >= s.left, struct(s.left as left, x.total_changes as least), struct(s.left - x.n as left, cast(null as bigint) as least))))"""
    found = bars.select(F.expr(walk).alias("s")).select("s.*").first()
    if found is None or found["least"] is None:
        return history.limit(0)
    tied = history.where(F.col("total_changes") == found["least"]).orderBy("path").limit(found["left"])
    return history.where(F.col("total_changes") > found["least"]).unionByName(tied)


def top_contributors(authors: DataFrame, n: int = 5) -> DataFrame:
    return authors.orderBy(F.desc("commits"), "name", "email").limit(n)
