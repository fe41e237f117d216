"""History, tree aggregation and report views on small hand-made tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolith import schema
from chronolith.operators import history as hs
from chronolith.operators import views as vw
from chronolith.operators import treeagg as tg
from chronolith.operators.treeagg import hot_keys, tree_aggregate
from chronolith.options import Options


def day(n: int) -> datetime:
    return datetime(2024, 1, n)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        ("c1", "m", "Ann", "a@x", None, None, day(1), day(2), 3, 1, None),
        ("c2", None, "Bob", None, None, None, day(2), day(3), 0, 0, None),
        ("c3", "", None, "a@x", None, None, None, None, None, None, None),
        ("c4", "m", "Ann", "a@x", None, None, day(9), day(9), 1, 1, None),
    ]
    files = [("c1", 0, "a/b.rs"), ("c1", 1, "a/b.rs"), ("c1", 2, "z"), ("c2", 0, "a/b.rs"), ("c4", 0, ".hidden"), ("c4", 1, "")]
    return spark.createDataFrame(rows, schema.COMMITS), spark.createDataFrame(files, schema.FILE_CHANGES)


def test_tree_aggregate_equals_group_by(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', if(id % 7 = 0, null, cast(id % 11 as string))) as k", "id as v", "'x' as chunk")
    for fan_in in (2, 3, 100):
        got = tree_aggregate(rows.repartition(13), ["k"], {"n": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, fan_in)
        want = rows.groupBy("k").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rounds_follow_the_chunks_of_the_input(spark):
    """A scan of 600 splits gets four rounds of fan-in 5 although a shuffle has 4 partitions; a round is one exchange."""
    df = spark.range(0, 6000, 1, 600).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k", "id as v")
    assert tg.input_chunks(df) == 600 and tg.input_chunks(df.repartition(32, "k")) == 32
    assert [tg.rounds_for(n, 5) for n in (1, 5, 6, 25, 26, 600)] == [1, 1, 2, 2, 3, 4]
    out = tg.tree_aggregate(df, ["k"], {"n": ("count", "v"), "s": ("sum", "v")}, fan_in=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
    assert out.where("k = 'hot'").first().asDict() == {"k": "hot", "n": 2000, "s": sum(range(0, 6000, 3))}
    assert out.count() == 4001
    flat = tg.tree_aggregate(df, ["k"], {"n": ("count", "v")}, fan_in=2, chunks=16)
    assert flat._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4


def test_tree_aggregate_edges(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert tree_aggregate(empty, ["k"], {"n": ("count", "v")}).count() == 0
    assert hot_keys(empty, "k", 0.5).count() == 0
    with pytest.raises(ValueError):
        tree_aggregate(empty, ["k"], {"k": ("count", "v")})
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert {(r.k, r.n, r.hot) for r in hot_keys(rows, "k", 0.5).collect()} == {("a", 2, True), ("b", 1, False)}


def test_authors_are_not_counted_once_per_file(tables):
    commits, files = tables
    got = {(r["name"], r.email): (r.commits, r.lines_added, r.files_touched) for r in hs.author_stats(commits, hs.capped_files(files)).collect()}
    assert got == {("Ann", "a@x"): (2, 4, 3), ("Bob", ""): (1, 0, 1), ("", "a@x"): (1, 0, 0)}


def test_file_history(tables):
    commits, files = tables
    rows = hs.file_history(commits, hs.capped_files(files))
    got = {r.path: (r.total_changes, r.authors, r.recent_commit, r.ref_recent_commit) for r in rows.collect()}
    assert got == {"a/b.rs": (2, 2, "c2", "c1"), "z": (1, 1, "c1", "c1"), ".hidden": (1, 1, "c4", "c4")}
    assert {r.path for r in hs.single_author_files(rows).collect()} == {"z", ".hidden"}
    assert [r.path for r in hs.high_churn_files(rows).collect()] == ["a/b.rs"]
    stale = hs.stale_files(rows, Options(as_of="2024-01-09 00:00:00", stale_days=7))
    assert {r.path for r in stale.collect()} == {"z"}, "strictly older than the limit"


def test_file_cap_counts_before_dropping_empty_names(tables):
    _, files = tables
    assert {r.path for r in hs.capped_files(files, Options(files_per_commit=1)).collect()} == {"a/b.rs", ".hidden"}


def test_totals_of_nothing(spark):
    commits, files = spark.createDataFrame([], schema.COMMITS), spark.createDataFrame([], schema.FILE_CHANGES)
    row = hs.repository_totals(commits, files).first()
    assert (row.total_commits, row.total_authors, row.total_files, row.last_commit) == (0, 0, 0, datetime(1970, 1, 1))


def test_extension_distribution(spark):
    rows = spark.createDataFrame([("a.RS",), ("b.rs",), ("x/.git",), ("Makefile",), ("q.c",)], "path string")
    got = [(r.place, r.extension, r["count"], r.percentage) for r in vw.extension_distribution(rows).orderBy("place").collect()]
    assert got == [(1, "rs", 2, 40.0), (2, "c", 1, 20.0), (3, "no extension", 2, 40.0)]


def test_pages(spark):
    assert [vw.pages(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]
    rows = spark.createDataFrame([(1, 3), (9, 10), (5, 10), (1, 0), (40, 10), (1, 1)], "page int, total int")
    got = [list(r.s) for r in rows.select(vw.page_strip(F.col("page"), F.col("total")).alias("s")).collect()]
    assert got == [[1, 2, 3], [6, 7, 8, 9, 10], [3, 4, 5, 6, 7], [], [6, 7, 8, 9, 10], [1]]


def test_numbers_without_one_task_for_all(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "pmod(xxhash64(id), 40) as n")
    got = [(r.place, r.n, r.id) for r in vw.numbered(rows, [F.desc("n"), F.asc("id")]).orderBy("place").collect()]
    want = sorted(((r.n, r.id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    assert got == [(i + 1, *x) for i, x in enumerate(want)]
    assert vw.numbered(rows.limit(0), [F.asc("id")]).count() == 0


@pytest.mark.parametrize("files", [0, 1, 9, 10, 25, 400])
def test_high_churn_is_the_first_tenth(spark, files):
    rows = spark.range(files).selectExpr("concat('p', pmod(id * 7919, 1000)) as path", "id div 30 as total_changes")
    got = {(r.path, r.total_changes) for r in hs.high_churn_files(rows).collect()}
    want = sorted(((-r.total_changes, r.path) for r in rows.collect()))[: max(files // 10, 1)]
    assert got == {(p, -n) for n, p in want}
