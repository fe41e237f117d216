"""Report views, links and the interactive filters, sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import bands, links
from chronolith.functions.paths import extension, first_line, second, short_id, short_name
from chronolith.operators import history as hs
from chronolith.operators import views as vw
from chronolith.options import DEFAULT
from chronolith.plans.base import REMOTE, SQL, SQL_FINDINGS, findings, findings_history, history, metrics, stamp
from chronolith.plans.code import ORACLES as CODE
from chronolith.sources.tables import changed_files, commits, table

BASE = "https://github.com/lantern/lantern-core"
REMOTES = (
    ("git@github.com:lantern/lantern-core.git",), ("https://gitlab.example/a/b.git",), ("https://bitbucket.org/a/b",),
    ("git@git.example:a/b.git",), ("https://gitlab.com/github/mirror",), ("git@broken",), (None,),
)


def a10_priority_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.priority_counts(findings(spark, sf_dir))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.priority_areas(findings(spark, sf_dir), history(spark, sf_dir), REMOTE)


def j3_priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir)


def _area_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vw.priority_counts(findings(spark, sf_dir)).orderBy(F.desc("total_findings"), "file").limit(15)
    return vw.priority_findings(findings(spark, sf_dir), top, REMOTE)


def j5_priority_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _area_findings(spark, sf_dir)
    return rows.select("file", "commit_id", "commit_message", "commit_url", "diff_url", "severity_class", F.array_join("patterns_matched", "|").alias("patterns"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.heat_counts(changed_files(spark, sf_dir))


def a11_heat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def a12_heat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.heat_stats(_counts(spark, sf_dir))


def j4_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = hs.author_names(commits(spark, sf_dir, "author"), changed_files(spark, sf_dir))
    return vw.heat_rows(_counts(spark, sf_dir), history(spark, sf_dir), names, REMOTE)


def x3_heat_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    most = counts.agg(F.max("commit_count").alias("m")).scalar()
    n = F.col("commit_count")
    return counts.select("path", bands.heat_band(n, most).alias("heat"), bands.commit_band(n).alias("fixed"), bands.churn_band(n).alias("churn"))


def t3_most_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).orderBy(F.desc("commit_count"), "path").limit(10)


def t5_single_author_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty files, by path, that one author alone changed; every file of the commits has several, so among those of the findings."""
    return hs.single_author_files(findings_history(spark, sf_dir)).select("path", "authors").orderBy("path").limit(20)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("percentage", F.round("percentage", 6))


def a13_ext_dist_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vw.extension_distribution(hs.single_author_files(history(spark, sf_dir))))


def a13_ext_dist_single_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vw.extension_distribution(hs.single_author_files(findings_history(spark, sf_dir))))


def w6_finding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the priority areas with their zero-based index in the area, by risk and commit."""
    rows = _area_findings(spark, sf_dir)
    place = Window.partitionBy("file").orderBy(F.desc(F.round("risk_score", 6)), "commit_id")
    return rows.select("file", "commit_id", (F.row_number().over(place) - 1).alias("index"))


def a13_ext_dist_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vw.extension_distribution(hs.stale_files(history(spark, sf_dir))))


def t6_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent extensions of all files."""
    return _rounded(vw.extension_distribution(history(spark, sf_dir)).where("place <= 10"))


def a14_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of single-author and of stale files."""
    rows = history(spark, sf_dir)
    limit = F.lit(DEFAULT.as_of).cast("timestamp") - F.expr(f"INTERVAL {DEFAULT.stale_days} DAYS")
    share = lambda condition: F.round(F.coalesce(F.try_divide(F.count_if(condition) * 100.0, F.count(F.lit(1))), F.lit(0.0)), 6)
    return rows.agg(share(F.col("authors") == 1).alias("single_author_percent"), share(F.col("last_commit") < limit).alias("stale_percent"))


def x1_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("risk_score")
    return findings(spark, sf_dir).select(
        "commit_id", bands.severity_text(score).alias("severity"), bands.severity_class(score).alias("severity_class"), bands.risk_class(score).alias("risk_class")
    )


def x5_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return changed_files(spark, sf_dir).select("path").distinct().select("path", extension(path).alias("extension"), short_name(path).alias("display_name"))


def x8_commit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir, "message", "authored_date")
    return rows.select("commit_id", short_id(F.col("commit_id")).alias("short"), first_line(F.col("message")).alias("first_line"), second(F.col("authored_date")).alias("at"))


def x12_base_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = F.col("remote")
    rows = spark.createDataFrame(list(REMOTES), "remote string")
    return rows.select(
        "remote", links.base_url(remote).alias("base_url"), links.repository_type(remote).alias("repository_type"), links.repository_name(remote).alias("name"),
        links.commit_url(remote, F.lit("abc")).alias("commit_url"), links.diff_url(remote, F.lit("abc")).alias("diff_url"),
        links.file_url(remote, F.lit("a/b.rs")).alias("file_url"), links.issue_url(remote, F.lit("7")).alias("issue_url"),
    )


def _commit_links(build, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return commits(spark, sf_dir).select("commit_id", build(F.lit(REMOTE), F.col("commit_id")).alias(name))

    return query


def x14_file_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_files(spark, sf_dir).select("commit_id", "path", links.file_url(F.lit(REMOTE), F.col("path"), F.col("commit_id")).alias("file_url"))


def x19_issue_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir, "message").select("commit_id", F.explode(links.issue_references(F.col("message"))).alias("issue"))
    return rows.select("commit_id", "issue", links.issue_url(F.lit(REMOTE), F.col("issue")).alias("issue_url"))


def f14_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vw.vulnerabilities(findings(spark, sf_dir), REMOTE)
    return rows.select(
        "commit_id", "commit_id_short", "severity_class", "risk_class", "severity_text", "commit_url", "diff_url",
        F.array_join(F.transform("issue_links", lambda x: x["url"]), " ").alias("issues"), F.size("file_links").cast("long").alias("files"),
    )


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.vulnerabilities(findings(spark, sf_dir), REMOTE)


def f8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.search(_view(spark, sf_dir), term="Buffer").select("commit_id")


def f9_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.search(_view(spark, sf_dir), severity="high").select("commit_id")


def f10_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.search(_view(spark, sf_dir), author="Yuki Holacdottir").select("commit_id")


def f11_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.filter_metrics(metrics(spark, sf_dir), "src", "rs").select("path")


def f12_heat_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).where(F.coalesce(extension(F.col("path")), F.lit("file")) == "py")


def f13_area_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vw.priority_counts(findings(spark, sf_dir)).orderBy(F.desc("total_findings"), "file").limit(15)
    return vw.search_areas(top, _area_findings(spark, sf_dir), "lock").select("file")


def _sorted(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = findings(spark, sf_dir).select("commit_id", "author", "date", "risk_score")
        return vw.page(rows, vw.ordering(vw.SORTS, mode, "commit_id"), 2, 10).select("commit_id")

    return query


def _metric_sorted(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vw.page(metrics(spark, sf_dir), vw.ordering(vw.METRIC_SORTS, mode, "path"), 1, 25).select("path")

    return query


def _area_sorted(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vw.page(vw.priority_counts(findings(spark, sf_dir)), vw.ordering(vw.AREA_SORTS, mode, "file"), 1, 25).select("file")

    return query


def t12_page_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result counts, and for every page of ten findings the strip of page numbers around it."""
    rows = findings(spark, sf_dir).agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / 10).cast("int"))
    rows = rows.where("pages > 0").withColumn("page", F.explode(F.sequence(F.lit(1), F.col("pages"))))
    return rows.select("total", "pages", "page", F.array_join(vw.page_strip(F.col("page"), F.col("pages")), " ").alias("strip"))


def t11_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, the second and a page far too high of the findings by risk, for every page size; 0 stands for all on one page."""
    rows = findings(spark, sf_dir).select("commit_id", "risk_score")
    total, order, out = rows.count(), vw.ordering(vw.SORTS, "risk-desc", "commit_id"), None
    for size in (10, 25, 50, None):
        last = vw.pages(total, size)
        for number in (1, 2, 9999):
            shown = vw.page(rows, order, min(number, last), size).select(
                F.lit(size or 0).alias("size"), F.lit(last).alias("pages"), F.lit(number).alias("page"), "commit_id"
            )
            out = shown if out is None else out.unionByName(shown)
    return out


def a22_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.distinct_sorted(findings(spark, sf_dir).withColumn("author", F.lower("author")), "author")


_AREA = """, fe as (select r.commit_id, f.path as file, risk from r join f on r.commit_id = f.commit_id),
ar as (select file, count(*) as total_findings, count(*) filter (risk >= 7) as high_risk_findings, count(*) filter (risk >= 4 and risk < 7) as medium_risk_findings,
  count(*) filter (risk < 4) as low_risk_findings from fe group by file), tp as (select * from ar order by total_findings desc, file limit 15),
n as (select path, count(*) as commit_count from f group by path), mx as (select max(commit_count) as m from n)
"""
_SEV = "case when risk >= 8 then 'critical' when risk >= 6 then 'high' when risk >= 4 then 'medium' when risk >= 2 then 'low' else 'info' end"
_FIRST = r"regexp_split_to_array(coalesce(message, ''), '\r?\n')[1]"
_NAME = "case when length(base) > 15 then base[1:12] || '...' else base end"
_HEAT = """case when commit_count <= m // 5 then 'commits-1' when commit_count <= m * 2 // 5 then 'commits-2' when commit_count <= m * 3 // 5 then 'commits-3'
  when commit_count <= m * 4 // 5 then 'commits-4' else 'commits-high' end"""
_LIMIT = f"timestamptz '{DEFAULT.as_of}+00' - interval 365 days"


def _dist(where: str) -> str:
    return SQL + f""", z as (select lower(e.ext) as ext, count(*) as n from h join e on h.path = e.path where {where} group by 1)
select cast(row_number() over (order by ext is null, n desc, ext) as int) as place, coalesce(ext, 'no extension') as extension, n as count,
  round(n * 100.0 / sum(n) over (), 6) as percentage from z"""


_METRIC_ORDER = {
    "complexity-desc": "cyclomatic_complexity desc", "complexity-asc": "cyclomatic_complexity", "maintainability-desc": "maintainability_index desc",
    "maintainability-asc": "maintainability_index", "lines-desc": "line_count desc", "name-asc": "lower(path)", "name-desc": "lower(path) desc",
}
_ORDER = {"risk-desc": "round(risk, 2) desc", "risk-asc": "round(risk, 2)", "date-desc": "authored_date desc nulls last", "date-asc": "authored_date nulls last", "author": "lower(coalesce(author, ''))"}
_AREA_ORDER = {"findings-desc": "total_findings desc", "critical-desc": "high_risk_findings desc", "name-asc": "lower(file)"}
_KNOWN = "select distinct k.* from file_complexity k join source_files s on k.path = s.path"

_REMOTES = """select remote, base_url, repository_type, name, commit_url, diff_url, file_url, issue_url from (values
  ('git@github.com:lantern/lantern-core.git', 'https://github.com/lantern/lantern-core', 'GitHub', 'GitHub', 'https://github.com/lantern/lantern-core/commit/abc',
   'https://github.com/lantern/lantern-core/commit/abc.diff', 'https://github.com/lantern/lantern-core/blob/main/a/b.rs', 'https://github.com/lantern/lantern-core/issues/7'),
  ('https://gitlab.example/a/b.git', 'https://gitlab.example/a/b', 'GitLab', 'GitLab', 'https://gitlab.example/a/b/-/commit/abc', 'https://gitlab.example/a/b/-/commit/abc.diff',
   'https://gitlab.example/a/b/-/blob/main/a/b.rs', 'https://gitlab.example/a/b/-/issues/7'),
  ('https://bitbucket.org/a/b', 'https://bitbucket.org/a/b', 'Bitbucket', 'Bitbucket', 'https://bitbucket.org/a/b/commits/abc', 'https://bitbucket.org/a/b/commits/abc/raw',
   'https://bitbucket.org/a/b/src/main/a/b.rs', 'https://bitbucket.org/a/b/issues/7'),
  ('git@git.example:a/b.git', 'https://git.example/a/b', 'Other', 'Git Repository', null, null, null, null),
  ('https://gitlab.com/github/mirror', 'https://gitlab.com/github/mirror', 'GitLab', 'GitLab', 'https://gitlab.com/github/mirror/-/commit/abc', 'https://gitlab.com/github/mirror/-/commit/abc.diff',
   'https://gitlab.com/github/mirror/-/blob/main/a/b.rs', 'https://gitlab.com/github/mirror/-/issues/7'),
  ('git@broken', null, 'Other', 'Git Repository', null, null, null, null),
  (null, null, 'Local', 'Local Repository', null, null, null, null)
) t(remote, base_url, repository_type, name, commit_url, diff_url, file_url, issue_url)"""

QUERIES = {
    "a10_priority_areas": a10_priority_areas, "j3_priority_join": j3_priority_join, "j5_priority_findings": j5_priority_findings,
    "a11_heat_counts": a11_heat_counts, "a12_heat_stats": a12_heat_stats, "j4_heatmap": j4_heatmap, "x3_heat_band": x3_heat_band,
    "t3_most_changed": t3_most_changed, "t5_single_author_top": t5_single_author_top, "a13_ext_dist_single": a13_ext_dist_single,
    "a13_ext_dist_single_findings": a13_ext_dist_single_findings, "w6_finding_index": w6_finding_index, "t11_pages": t11_pages,
    "a13_ext_dist_stale": a13_ext_dist_stale, "t6_extensions": t6_extensions, "a14_shares": a14_shares, "x1_bands": x1_bands,
    "x5_path_parts": x5_path_parts, "x8_commit_text": x8_commit_text, "x12_base_url": x12_base_url,
    "x13_commit_url": _commit_links(links.commit_url, "commit_url"), "x15_diff_url": _commit_links(links.diff_url, "diff_url"),
    "x14_file_url": x14_file_url, "x19_issue_refs": x19_issue_refs, "f14_vulnerabilities": f14_vulnerabilities,
    "f8_search": f8_search, "f9_severity": f9_severity, "f10_author": f10_author, "f11_ext_filter": f11_ext_filter,
    "f12_heat_filter": f12_heat_filter, "f13_area_search": f13_area_search, "a22_authors": a22_authors, "t12_page_strip": t12_page_strip,
    **{f"t8_sort_{m.replace('-', '_')}": _sorted(m) for m in vw.SORTS},
    **{f"t9_sort_{m.replace('-', '_')}": _metric_sorted(m) for m in vw.METRIC_SORTS},
    **{f"t10_sort_{m.replace('-', '_')}": _area_sorted(m) for m in vw.AREA_SORTS if m != "priority-desc"},
}
ORACLES = {
    "x12_base_url": _REMOTES,
    "f14_vulnerabilities": SQL + rf""", i as (select commit_id, list_distinct(flatten([regexp_extract_all(coalesce(message, ''), '#(\d+)', 1), regexp_extract_all(coalesce(message, ''), 'issue\s+#?(\d+)', 1),
  regexp_extract_all(coalesce(message, ''), 'fixes?\s+#?(\d+)', 1), regexp_extract_all(coalesce(message, ''), 'closes?\s+#?(\d+)', 1), regexp_extract_all(coalesce(message, ''), 'resolves?\s+#?(\d+)', 1)])) as a from c)
  select r.commit_id, r.commit_id[1:8] as commit_id_short, 'severity-' || {_SEV} as severity_class,
  case when risk >= 8 then 'risk-critical' when risk >= 6 then 'risk-high' when risk >= 4 then 'risk-medium' else 'risk-low' end as risk_class, {_SEV} as severity_text,
  '{BASE}/commit/' || r.commit_id as commit_url, '{BASE}/commit/' || r.commit_id || '.diff' as diff_url, array_to_string(list_transform(a, lambda n: '{BASE}/issues/' || n), ' ') as issues,
  coalesce(nf.n, 0) as files from r join i on r.commit_id = i.commit_id left join nf on r.commit_id = nf.commit_id""",
    "a10_priority_areas": SQL + _AREA + "select * from ar",
    "j3_priority_join": SQL + _AREA + f"""select file, total_findings, high_risk_findings, medium_risk_findings, low_risk_findings, '{BASE}/blob/main/' || file as file_url,
  recent_commit as recent_commit_id, recent_commit[1:8] as commit_id_short, '{BASE}/commit/' || recent_commit as commit_url, ref_recent_commit from tp join h on tp.file = h.path""",
    "j5_priority_findings": SQL + _AREA + f"""select fe.file, fe.commit_id, {_FIRST} as commit_message, '{BASE}/commit/' || fe.commit_id as commit_url,
  '{BASE}/commit/' || fe.commit_id || '.diff' as diff_url, 'severity-' || (case when fe.risk >= 8 then 'critical' when fe.risk >= 6 then 'high' when fe.risk >= 4 then 'medium' when fe.risk >= 2 then 'low' else 'info' end) as severity_class,
  array_to_string(names, '|') as patterns from fe join tp on fe.file = tp.file join c on fe.commit_id = c.commit_id join r on fe.commit_id = r.commit_id""",
    "a11_heat_counts": SQL + _AREA + "select * from n",
    "a12_heat_stats": SQL + _AREA + """select m as max_commits, m * 2 // 5 as threshold_2, m * 4 // 5 as threshold_4, count(*) filter (commit_count > m * 4 // 5) as high_churn_files,
  count(*) filter (commit_count > m * 2 // 5 and commit_count <= m * 4 // 5) as medium_churn_files, count(*) filter (commit_count <= m * 2 // 5) as low_churn_files from n, mx group by m""",
    "j4_heatmap": SQL + _AREA + f""", an as (select path, list_sort(list(distinct author)) as a from f join c on f.commit_id = c.commit_id where author is not null group by path)
  select n.path, commit_count, {_HEAT} as css_class, coalesce(e.ext, 'file') as extension, {_NAME} as display_name,
  case when a is null then 'Unknown' when len(a) <= 3 then array_to_string(a, ', ') else a[1] || ', ' || a[2] || ' and ' || (len(a) - 2) || ' more' end as authors,
  strftime(h.last_commit at time zone 'UTC', '%Y-%m-%d') as last_modified, '{BASE}/blob/main/' || n.path as file_url
  from n cross join mx join h on n.path = h.path join x on n.path = x.path join e on n.path = e.path left join an on n.path = an.path""",
    "x3_heat_band": SQL + _AREA + f"""select path, {_HEAT} as heat, case when commit_count <= 2 then 'commits-1' when commit_count <= 5 then 'commits-2' when commit_count <= 10 then 'commits-3'
  when commit_count <= 20 then 'commits-4' else 'commits-high' end as fixed, case when commit_count <= 5 then 'churn-low' when commit_count <= 15 then 'churn-medium' when commit_count <= 30 then 'churn-high'
  else 'churn-critical' end as churn from n, mx""",
    "t3_most_changed": SQL + _AREA + "select * from n order by commit_count desc, path limit 10",
    "t5_single_author_top": SQL_FINDINGS + "select path, authors from h where authors = 1 order by path limit 20",
    "a13_ext_dist_single_findings": SQL_FINDINGS + """, z as (select ext, count(*) as n from h join e on h.path = e.path where authors = 1 group by 1)
  select cast(row_number() over (order by ext is null, n desc, ext) as int) as place, coalesce(ext, 'no extension') as extension, n as count, round(n * 100.0 / sum(n) over (), 6) as percentage from z""",
    "w6_finding_index": SQL + _AREA + """select fe.file, fe.commit_id, cast(row_number() over (partition by fe.file order by round(fe.risk, 6) desc, fe.commit_id) - 1 as int) as index
  from fe join tp on fe.file = tp.file""",
    "t11_pages": SQL + """, q as (select *, row_number() over (order by round(risk, 2) desc, commit_id) as k, count(*) over () as n from r),
  sz(size) as (values (10), (25), (50), (0)), wp as (select size, cast(case when size = 0 then 1 else (n + size - 1) // size end as int) as pages, n from sz, (select count(*) as n from r))
  select size, pages, p as page, commit_id from wp, (values (1), (2), (9999)) g(p), q
  where wp.size = 0 or (k > (least(p, wp.pages) - 1) * wp.size and k <= least(p, wp.pages) * wp.size)""",
    "a13_ext_dist_single": _dist("authors = 1"),
    "a13_ext_dist_stale": _dist(f"h.last_commit < {_LIMIT}"),
    "t6_extensions": f"select * from ({_dist('true')}) where place <= 10",
    "a14_shares": SQL + f"select round(count(*) filter (authors = 1) * 100.0 / count(*), 6) as single_author_percent, round(count(*) filter (h.last_commit < {_LIMIT}) * 100.0 / count(*), 6) as stale_percent from h",
    "x1_bands": SQL + f"select commit_id, {_SEV} as severity, 'severity-' || {_SEV} as severity_class, case when risk >= 8 then 'risk-critical' when risk >= 6 then 'risk-high' when risk >= 4 then 'risk-medium' else 'risk-low' end as risk_class from r",
    "x5_path_parts": SQL + f"select x.path, e.ext as extension, {_NAME} as display_name from x join e on x.path = e.path where x.path in (select path from f)",
    "x8_commit_text": SQL + f"select commit_id, commit_id[1:8] as short, {_FIRST} as first_line, {stamp('authored_date')} as at from c",
    "x13_commit_url": SQL + f"select commit_id, '{BASE}/commit/' || commit_id as commit_url from c",
    "x15_diff_url": SQL + f"select commit_id, '{BASE}/commit/' || commit_id || '.diff' as diff_url from c",
    "x14_file_url": SQL + f"select commit_id, path, '{BASE}/blob/' || commit_id || '/' || path as file_url from f",
    "x19_issue_refs": SQL + rf""", i as (select commit_id, list_distinct(flatten([regexp_extract_all(coalesce(message, ''), '#(\d+)', 1), regexp_extract_all(coalesce(message, ''), 'issue\s+#?(\d+)', 1),
  regexp_extract_all(coalesce(message, ''), 'fixes?\s+#?(\d+)', 1), regexp_extract_all(coalesce(message, ''), 'closes?\s+#?(\d+)', 1), regexp_extract_all(coalesce(message, ''), 'resolves?\s+#?(\d+)', 1)])) as a from c)
  select commit_id, issue, '{BASE}/issues/' || issue as issue_url from (select commit_id, unnest(a) as issue from i)""",
    "f8_search": SQL + """select r.commit_id from r join c on r.commit_id = c.commit_id left join (select commit_id, string_agg(path, ' ' order by path) as files from f group by 1) g on r.commit_id = g.commit_id
  where contains(lower(coalesce(message, '') || ' ' || coalesce(author, '') || ' ' || coalesce(files, '')), 'buffer')""",
    "f9_severity": SQL + f"select commit_id from r where {_SEV} = 'high'",
    "f10_author": SQL + "select r.commit_id from r join c on r.commit_id = c.commit_id where lower(author) = 'yuki holacdottir'",
    "f11_ext_filter": "select path from (" + _KNOWN + ") where contains(lower(path), 'src') and lower(path) like '%.rs'",
    "f12_heat_filter": SQL + _AREA + "select n.path, commit_count from n join e on n.path = e.path where ext = 'py'",
    "f13_area_search": SQL + _AREA + f"""select distinct tp.file from tp join fe on tp.file = fe.file join c on fe.commit_id = c.commit_id join r on r.commit_id = c.commit_id
  where contains(lower(tp.file), 'lock') or contains(lower({_FIRST} || ' ' || coalesce(author, '') || ' ' || array_to_string(names, ' ')), 'lock')""",
    "a22_authors": SQL + "select distinct lower(author) as author from r join c on r.commit_id = c.commit_id where author is not null",
    "t12_page_strip": SQL + """, q as (select count(*) as total, cast(ceil(count(*) / 10.0) as int) as pages from r),
  pg as (select total, pages, cast(unnest(range(1, pages + 1)) as int) as page from q),
  a as (select *, unnest(range(1, pages + 1)) as shown from pg)
  select total, pages, page, string_agg(shown, ' ' order by shown) as strip from a
  where shown between page - 2 and page + 2 or (page <= 2 and shown <= 5) or (page > pages - 2 and shown > pages - 5) group by all""",
    **{
        f"t8_sort_{m.replace('-', '_')}": SQL + f"select r.commit_id from r join c on r.commit_id = c.commit_id order by {o}, r.commit_id limit 10 offset 10"
        for m, o in _ORDER.items()
    },
    **{f"t9_sort_{m.replace('-', '_')}": f"select path from ({_KNOWN}) order by {o}, path limit 25" for m, o in _METRIC_ORDER.items()},
    **{
        f"t9_sort_{m}": f"select path from ({CODE[of]}) where path in (select path from file_complexity) order by {o}, path limit 25"
        for m, of, o in (
            ("cognitive_desc", "a18_cognitive", "cognitive_complexity desc"),
            ("cognitive_asc", "a18_cognitive", "cognitive_complexity"),
            ("functions_desc", "a19_functions", "function_count desc"),
        )
    },
    **{f"t10_sort_{m.replace('-', '_')}": SQL + _AREA + f"select file from ar order by {o}, file limit 25" for m, o in _AREA_ORDER.items()},
}
