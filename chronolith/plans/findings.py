"""Pattern matches, findings and pattern sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.paths import second
from chronolith.operators import patterns as pt
from chronolith.options import CustomPattern, Options
from chronolith.plans.base import ALL, SQL, findings, matched_commits, sql_examples, stamp


def s16_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(p.ord, p.name, p.severity, p.category, p.cwe, p.description, "|".join(p.examples)) for p in pt.builtin_patterns()]
    return spark.createDataFrame(rows, "ord int, name string, severity string, category string, cwe string, description string, examples string")


def s16_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each example of a pattern matches its own pattern."""
    patterns = pt.builtin_patterns()
    shown = spark.createDataFrame([(p.ord, e) for p in patterns for e in p.examples], "ord int, example string")
    found = shown.select("ord", "example", F.transform(pt.matches(F.col("example"), patterns), lambda m: m["ord"]).alias("matched"))
    return found.select("ord", "example", F.array_contains("matched", F.col("ord")).alias("matches_itself"))


def e2_custom_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with a pattern of one's own, numbered behind the built-in ones."""
    options = Options(patterns="crypto", custom_patterns=(CustomPattern("Lock", r"\b(lock(?:ed|s)?)\b", "Low"),))
    exploded = matched_commits(spark, sf_dir, options).select("commit_id", F.explode(pt.described(F.col("hits"), pt.pattern_set("crypto", options))).alias("m"))
    return exploded.select("commit_id", "m.ord", "m.pattern_name", "m.matched_text", "m.severity")


def j2_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = pt.pattern_set("all")
    exploded = matched_commits(spark, sf_dir).select("commit_id", F.explode(pt.described(F.col("hits"), chosen)).alias("m"))
    return exploded.select(
        "commit_id", "m.ord", "m.pattern_name", "m.matched_text", "m.severity", "m.category",
        F.array_join("m.cve_references", ",").alias("cve"),
    )


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "commit_id", "author", second(F.col("date")).alias("date"), F.size("files_changed").cast("long").alias("files"),
        F.array_join("patterns_matched", "|").alias("patterns"), F.round("risk_score", 6).alias("risk_score"),
        F.array_join("cve_references", ",").alias("cve"),
    )


def f5_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that look like security fixes, and how risky they are."""
    return _flat(findings(spark, sf_dir))


def a5_finding_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("commit_id", F.round("risk_score", 6).alias("risk_score"))


def f3_cve_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(findings(spark, sf_dir).where(F.size("cve_references") > 0))


def _set(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = findings(spark, sf_dir, pt.DEFAULT.__class__(patterns=name))
        return rows.select("commit_id", F.array_join("patterns_matched", "|").alias("patterns"), F.round("risk_score", 6).alias("risk_score"))

    return query


_FLAT = f"""select r.commit_id, c.author, {stamp("c.authored_date")} as date, coalesce(nf.n, 0) as files,
  array_to_string(names, '|') as patterns, round(risk, 6) as risk_score, coalesce(cve, '') as cve
  from r join c on r.commit_id = c.commit_id left join nf on r.commit_id = nf.commit_id"""
_SET_WHERE = {"memorysafety": "category = 'MemorySafety'", "crypto": "category = 'Cryptography'", "web": "category = 'WebSecurity'", "vuln": "category <> 'Generic'", "all": "true"}

QUERIES = {
    "s16_patterns": s16_patterns,
    "s16_examples": s16_examples,
    "e2_custom_pattern": e2_custom_pattern,
    "j2_pattern_match": j2_pattern_match,
    "a5_finding_risk": a5_finding_risk,
    "f5_findings": f5_findings,
    "f3_cve_only": f3_cve_only,
    **{f"f4_set_{name}": _set(name) for name in _SET_WHERE},
}
ORACLES = {
    "s16_patterns": SQL + "select ord, name, severity, category, cwe, description, examples from p",
    "s16_examples": SQL + f"select p.ord, example, regexp_matches(example, pattern) as matches_itself from p join (values {sql_examples()}) e(ord, example) on p.ord = e.ord",
    "e2_custom_pattern": SQL
    + r"""select commit_id, ord, name as pattern_name, matched_text, severity from m where ord = 10
  union all select commit_id, 13, 'Lock', regexp_extract(message, '(?i)\b(lock(?:ed|s)?)\b', 0), 'Low' from c where regexp_matches(message, '(?i)\b(lock(?:ed|s)?)\b')""",
    "j2_pattern_match": SQL
    + "select commit_id, ord, name as pattern_name, matched_text, severity, category, case when ord >= 11 and cve <> 'CVE-' then cve else '' end as cve from m",
    "a5_finding_risk": SQL + "select commit_id, round(risk, 6) as risk_score from r",
    "f5_findings": SQL + _FLAT,
    "f3_cve_only": SQL + _FLAT + " where cve is not null",
    **{
        f"f4_set_{name}": SQL
        + f"""select w.commit_id, array_to_string(list(name order by ord), '|') as patterns,
  round(least(sum(weight) * sqrt(coalesce(any_value(nf.n), 0)) * case when bool_or(name = 'CVE Reference') then 2.0 else 1.0 end, 10.0), 6) as risk_score
  from w left join nf on w.commit_id = nf.commit_id where {where} group by w.commit_id"""
        for name, where in _SET_WHERE.items()
    },
}

__all__ = ["ALL", "ORACLES", "QUERIES"]
