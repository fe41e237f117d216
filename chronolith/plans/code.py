"""Source-code metrics, languages, manifests and the risks of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import complexity as cx
from chronolith.operators import risk as rk
from chronolith.operators import views as vw
from chronolith.plans.base import SQL, findings, history, metrics
from chronolith.sources.manifests import cargo_entries, dependency_analysis, dependency_counts, npm_entries
from chronolith.sources.tables import table


def s8_analysed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.analysed(table(spark, sf_dir, "source_files")).select("path")


def s10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.source_lines(table(spark, sf_dir, "source_files"))


def s11_language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.language_stats(table(spark, sf_dir, "source_files"))


def a17_cyclomatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("path", "cyclomatic_complexity")


def w2_max_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("path", "nesting_depth")


def m5_maintainability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("path", "line_count", F.round("maintainability_index", 6).alias("maintainability_index"))


def a18_cognitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("path", "cognitive_complexity")


def a19_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("path", "function_count")


def f6_high_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.high_complexity(metrics(spark, sf_dir)).select("path", "cyclomatic_complexity")


def rf_risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cx.risk_factors(metrics(spark, sf_dir))
    return rows.withColumn("affected_files", F.array_join("affected_files", "|"))


def a15_language_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.language_totals(s11_language_stats(spark, sf_dir))


def s13_dependency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both manifest counters count in every source file and document."""
    files = table(spark, sf_dir, "source_files").select(F.col("path").alias("name"), F.col("content").alias("text"))
    texts = table(spark, sf_dir, "documents").select(F.format_string("document %d", "doc_id").alias("name"), "text")
    text = F.coalesce("text", F.lit(""))
    return files.unionByName(texts).select("name", cargo_entries(text).alias("cargo"), npm_entries(text).alias("npm"))


def a21_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency analysis of trees whose manifests are all source files and documents."""
    counts = s13_dependency_lines(spark, sf_dir).select((F.col("cargo") + F.col("npm")).alias("dependencies"))
    row = dependency_analysis(counts)
    return row.select("total_dependencies", *(F.size(c).alias(c) for c in ("outdated_dependencies", "vulnerable_dependencies", "license_issues")))


def a22_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.extensions(table(spark, sf_dir, "source_files"))


def a6_git_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.git_risk(history(spark, sf_dir)).select(F.round("git_risk", 6).alias("git_risk"))


def a7_code_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.code_risk(metrics(spark, sf_dir)).select(F.round("code_risk", 6).alias("code_risk"))


def a8_vuln_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rk.vulnerability_risk(findings(spark, sf_dir)).select(F.round("vulnerability_risk", 6).alias("vulnerability_risk"))


def a9_overall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rk.overall_risk(rk.git_risk(history(spark, sf_dir)), rk.code_risk(metrics(spark, sf_dir)), rk.vulnerability_risk(findings(spark, sf_dir)))
    return rows.select(*(F.round(c, 6).alias(c) for c in ("git_risk", "code_risk", "vulnerability_risk", "overall_risk")), "risk_percent")


MANIFESTS = (
    ("Cargo.toml", '[package]\nname = "a"\n# x = 1\nversion = "1"\n\n[dependencies]\nserde = "1"\n'),
    ("package.json", '{"name": "a", "dependencies": {"b": "1", "c": "2", "d": "3"}}'),
    ("requirements.txt", "a==1\nb==2\n"),
)


def s12_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest counters on a fixed example; the tables hold no manifests."""
    return dependency_counts(spark.createDataFrame(list(MANIFESTS), "path string, content string"))


_GIVEN = "with g as (select distinct k.* from file_complexity k join source_files s on k.path = s.path)\n"
_LINES = r"""
with s as (select path, content from source_files),
l0 as (select path, regexp_split_to_array(content, '\r?\n') as a from s where content is not null and content <> ''),
l1 as (select path, case when a[len(a)] = '' then a[1:len(a) - 1] else a end as a from l0),
l as (select path, unnest(a) as text, generate_subscripts(a, 1) as line_no from l1),
x as (select path, regexp_extract(path, '\.([^./]*)$', 1) as ext from s),
t as (select l.path, line_no, ext, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') as t from l join x on l.path = x.path),
k as (select * from t where t <> '' and not (starts_with(t, '//') or starts_with(t, '#') or starts_with(t, '/*') or starts_with(t, '*')))
"""
_COGNITIVE = r"""
, d as (select *, case when ext = 'py' then (case when regexp_matches(t, '^(if |for |while |try:|with )') then 1 else 0 end)
  else (case when contains(t, '{') then 1 else 0 end) - (case when contains(t, '}') then 1 else 0 end) end as opening,
  case when contains(t, '}') or ext = 'py' then -1 else 0 end as closing from k),
u as (select path, line_no, 0 as step, opening as d from d union all select path, line_no, 1, closing from d),
q as (select *, sum(d) over w as s from u window w as (partition by path order by line_no, step)),
v as (select path, line_no, step, s - least(0, min(s) over (partition by path order by line_no, step)) as level from q),
y as (select d.path, d.t, d.ext, v.level,
  (case when contains(t, 'if ') or contains(t, 'else if') or contains(t, 'elif ') then 1 when contains(t, 'else') and not contains(t, 'if') then 1 else 0 end)
  + (case when contains(t, 'for ') or contains(t, 'while ') or contains(t, 'do ') then 1 else 0 end) + (case when contains(t, 'switch ') then 1 else 0 end)
  + (case when contains(t, 'try') or contains(t, 'catch') or contains(t, 'except') then 1 else 0 end)
  + (case when ext = 'rs' and contains(t, 'match ') then 1 when ext in ('js', 'ts') and (contains(t, '.then(') or contains(t, '.catch(')) then 1
    when ext in ('c', 'h', 'cpp', 'hpp') and contains(t, '#if') then 1 else 0 end) as nested,
  (case when contains(t, '&&') or contains(t, '||') then 0.5 else 0 end) + 0.5 * (length(t) - length(replace(t, '?', '')))
  + (case when ext = 'rs' and contains(t, '?') and not contains(t, '"') then 1 when ext in ('js', 'ts') and (contains(t, 'async ') or contains(t, 'await ')) then 1 else 0 end)
  + (case when ext in ('c', 'h', 'cpp', 'hpp') then (case when contains(t, 'goto ') then 3 else 0 end) + (case when contains(t, 'setjmp') or contains(t, 'longjmp') then 4 else 0 end)
    + (case when contains(t, '(*') and contains(t, ')(') then 2 else 0 end) else 0 end) as flat
  from d join v on d.path = v.path and d.line_no = v.line_no and v.step = 0)
"""
_ANALYSED = "ext in ('rs', 'py', 'js', 'ts', 'java', 'cpp', 'c', 'h', 'hpp', 'go', 'rb', 'php', 'cs')"
_FUNCTION = r"""case when ext = 'rs' then starts_with(t, 'fn ') or contains(t, ' fn ') or starts_with(t, 'async fn ')
  when ext = 'py' then starts_with(t, 'def ') or starts_with(t, 'async def ')
  when ext in ('js', 'ts') then contains(t, 'function ') or contains(t, '=> {') or contains(t, 'async function') or contains(t, 'function*')
  when ext in ('java', 'cs') then regexp_matches(t, ' (void|int|string|bool|double|float) ') and contains(t, '(') and not contains(t, '=')
  when ext in ('c', 'h', 'cpp', 'hpp') then (contains(t, '(') and contains(t, ')') and contains(t, '{')) or starts_with(t, 'static ') or starts_with(t, 'extern ')
    or contains(t, ' main(') or contains(t, 'void ') or contains(t, 'int ')
  when ext = 'go' then starts_with(t, 'func ') or contains(t, ' func ') when ext = 'rb' then starts_with(t, 'def ') or contains(t, ' def ')
  when ext = 'php' then contains(t, 'function ') else contains(t, 'function ') or contains(t, 'def ') or contains(t, 'fn ') end"""
_DEPENDENCIES = r"""
with a as (select path as name, coalesce(content, '') as text from source_files union all select 'document ' || doc_id, coalesce(text, '') from documents),
n as (select name, len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: contains(x, '=') and not starts_with(x, '#'))) as cargo,
  (length(text) - length(replace(text, '":', ''))) // 2 // 2 as npm from a)
"""
_NAMES = ", ".join(f"('{e}', '{n}')" for e, n in cx.LANGUAGES.items())
_GIT = """(select 2.0 * count(*) filter (authors = 1) / count(*) + 1.5 * count(*) filter (h.last_commit < timestamptz '2026-05-01 00:00:00+00' - interval 365 days) / count(*)
  + greatest(count(*) // 10, 1) / count(*)::double from h)"""
_CODE = """(select 2.0 * count(*) filter (cyclomatic_complexity > 10) / count(*) from (select distinct k.* from file_complexity k join source_files s on k.path = s.path))"""
_VULN = "(select least(sum(risk / 10), 5.0) from r)"

QUERIES = {
    "s8_analysed_files": s8_analysed_files, "s10_lines": s10_lines, "s11_language_stats": s11_language_stats, "s12_manifests": s12_manifests,
    "a17_cyclomatic": a17_cyclomatic, "a18_cognitive": a18_cognitive, "w2_max_nesting": w2_max_nesting, "a19_functions": a19_functions,
    "m5_maintainability": m5_maintainability, "f6_high_complexity": f6_high_complexity, "rf_risk_factors": rf_risk_factors,
    "a15_language_totals": a15_language_totals, "s13_dependency_lines": s13_dependency_lines, "a21_dependencies": a21_dependencies, "a22_extensions": a22_extensions,
    "a6_git_risk": a6_git_risk, "a7_code_risk": a7_code_risk, "a8_vuln_risk": a8_vuln_risk, "a9_overall_risk": a9_overall_risk,
}
ORACLES = {
    "s8_analysed_files": _LINES + f"select path from x where {_ANALYSED}",
    "s10_lines": _LINES + "select path, cast(line_no as int) as line_no, text from l",
    "s11_language_stats": _LINES + f""", n(ext, language) as (values {_NAMES}),
  z as (select x.path, language, count(t.line_no) as n, count(t.line_no) filter (t = '') as b,
  count(t.line_no) filter (starts_with(t, '//') or starts_with(t, '#') or starts_with(t, '/*') or starts_with(t, '*')) as m
  from x join n on x.ext = n.ext left join t on t.path = x.path group by 1, 2)
  select language, count(*) as files, cast(sum(n) as bigint) as lines, cast(sum(b) as bigint) as blank_lines, cast(sum(m) as bigint) as comment_lines,
  round(sum(n) * 100.0 / sum(sum(n)) over (), 1) as line_percent from z group by language""",
    "s12_manifests": "select * from (values ('Cargo.toml', 3::bigint), ('package.json', 2::bigint)) t(manifest, dependencies)",
    "a17_cyclomatic": _GIVEN + "select path, cyclomatic_complexity from g",
    "w2_max_nesting": _GIVEN + "select path, nesting_depth from g",
    "m5_maintainability": _GIVEN + "select path, line_count, round(maintainability_index, 6) as maintainability_index from g",
    "a18_cognitive": _LINES + _COGNITIVE + f"""select x.path, cast(coalesce(sum(nested * (1 + level) + flat), 0) as double) as cognitive_complexity
  from x left join y on x.path = y.path where x.{_ANALYSED} group by x.path""",
    "a19_functions": _LINES + f"""select x.path, count(n.path) as function_count from x left join (select path from t where {_FUNCTION}) n on n.path = x.path
  where x.{_ANALYSED} group by x.path""",
    "f6_high_complexity": _GIVEN + "select path, cyclomatic_complexity from g where cyclomatic_complexity > 10",
    "rf_risk_factors": _GIVEN + """select path, 'HighComplexity' as factor_type, case when cyclomatic_complexity > 25 then 'High' else 'Medium' end as severity,
  'File ' || path || ' has high cyclomatic complexity (' || regexp_replace(cyclomatic_complexity::varchar, '\\.0$', '') || ')' as description, path as affected_files,
  'Consider refactoring to reduce complexity' as recommendation from g where cyclomatic_complexity > 15
  union all select path, 'DeepNesting', 'Medium', 'File ' || path || ' has deep nesting (depth: ' || nesting_depth || ')', path,
  'Consider extracting nested logic into separate functions' from g where nesting_depth > 5""",
    "a15_language_totals": _LINES + f"""select cast((select count(*) from t where {_ANALYSED}) as bigint) as total_lines,
  (select count(*) from x where {_ANALYSED}) as total_files""",
    "s13_dependency_lines": _DEPENDENCIES + "select * from n",
    "a21_dependencies": _DEPENDENCIES + "select cast(sum(cargo + npm) as bigint) as total_dependencies, 0 as outdated_dependencies, 0 as vulnerable_dependencies, 0 as license_issues from n",
    "a22_extensions": _LINES + "select distinct case when regexp_matches(path, '[^/]\\.[^./]*$') then lower(ext) else 'no-ext' end as extension from x",
    "a6_git_risk": SQL + f"select round({_GIT}, 6) as git_risk",
    "a7_code_risk": f"select round({_CODE}, 6) as code_risk",
    "a8_vuln_risk": SQL + f"select round({_VULN}, 6) as vulnerability_risk",
    "a9_overall_risk": SQL + f"""select round(g, 6) as git_risk, round(k, 6) as code_risk, round(v, 6) as vulnerability_risk, round(least(g + k + v, 10.0), 6) as overall_risk,
  cast(trunc(round(least(g + k + v, 10.0) * 10, 9)) as int) as risk_percent from (select {_GIT} as g, {_CODE} as k, {_VULN} as v)""",
}
