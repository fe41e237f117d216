"""Patterns, findings and links: boundary values and edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronolith import schema
from chronolith.functions import bands, links
from chronolith.operators import patterns as pt
from chronolith.operators import risk as rk
from chronolith.options import CustomPattern, Options

HITS = [
    ("fix use-after-free", ["Use After Free"]),
    ("a stack overflow and BOF", ["Buffer Overflow"]),
    ("double free", ["Double Free"]),
    ("data-race", ["Race Condition"]),
    ("mem leak", ["Memory Leak"]),
    ("SIGSEGV", ["Null Pointer Dereference"]),
    ("remote code execution", ["Code Injection"]),
    ("type confusion", ["Type confusion"]),
    ("privilege escalation", ["Authentication Bypass"]),
    ("XSS", ["Cross-Site Scripting"]),
    ("use md5", ["Weak Cryptography"]),
    ("cve 2021 12345", ["CVE Reference"]),
    ("security patch", ["Security Fix"]),
    ("Segmentation fault", []),
    ("confusedly", []),
    ("üdes x", []),
    ("use after free", ["Use After Free"]),
    ("", []),
    (None, []),
]


def test_matches(spark):
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(HITS)], "i int, message string")
    found = rows.select("i", pt.matches(F.col("message"), pt.pattern_set("all")).alias("m")).collect()
    assert {r.i: [m.pattern_name for m in r.m] for r in found} == {i: names for i, (_, names) in enumerate(HITS)}


ODD = ["ſecurity fix", "MEMORY LEAK", "memory leaK", "ﬁx ußeful Fallthrough", "İ nullptr dereference", "ſha1 and md5", "DOUBLE\u2003FREE", "жuaf", "uafж", "ß RCE", "sİgsegv", "sıgsegv", "", "x" * 5000 + " bof"]


def test_the_quick_way_finds_what_the_expressions_find(spark):
    """Folded words only save work: for every text the same as trying each expression on it."""
    every = pt.pattern_set("all")
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice([*"abKſß\u2003ı -", "uaf", "use after free", "CVE-2021-1234", "ÉXPLOIT", "exploit"]) for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "message string")
    got = rows.select("message", pt.any_match(F.col("message"), every).alias("quick"), F.size(pt.hits(F.col("message"), every)).alias("n")).collect()
    assert all(r.quick == (r.n > 0) for r in got) and 20 < sum(r.quick for r in got) < len(got)


def test_custom_patterns_are_numbered_behind_the_built_in_ones():
    own = Options(patterns="web", custom_patterns=(CustomPattern("A", "a"), CustomPattern("B", "b", "High", description="of b")))
    assert [(p.ord, p.name) for p in pt.pattern_set("web", own)] == [(9, "Cross-Site Scripting"), (13, "A"), (14, "B")]
    assert pt.pattern_set("web", own)[-1].description == "of b"


def test_sets():
    assert {n: len(pt.pattern_set(n)) for n in ("memorysafety", "crypto", "web", "vuln", "all", "memory")} == {
        "memorysafety": 5, "crypto": 1, "web": 1, "vuln": 11, "all": 13, "memory": 11,
    }
    own = Options(custom_patterns=(CustomPattern("Todo", r"\btodo\b", "Low"),))
    assert pt.pattern_set("web", own)[-1].name == "Todo"


@pytest.mark.parametrize(("message", "files", "score"), [("uaf", 1, 9.0), ("uaf", 0, 0.0), ("uaf", 4, 10.0), ("cve-2020-1234", 4, 4.0), ("mem leak xss", 1, 10.0)])
def test_risk(spark, message, files, score):
    commits = spark.createDataFrame([("c", message, "a", None)], "commit_id string, message string, author string, authored_date timestamp")
    changed = spark.createDataFrame([("c", f"p{i}") for i in range(files)], "commit_id string, path string")
    assert pt.findings(commits, changed, Options(patterns="all")).first().risk_score == score


def test_cve_is_kept_verbatim_and_only_from_its_pattern_on(spark):
    rows = spark.createDataFrame([("Fix uaf, cve 2021 1234, exploit",)], "message string")
    matched = rows.select(pt.matches(F.col("message"), pt.pattern_set("all")).alias("m")).first().m
    assert [(m.pattern_name, m.cve_references) for m in matched] == [
        ("Use After Free", []), ("CVE Reference", ["CVE-2021 1234"]), ("Security Fix", ["CVE-2021 1234"]),
    ]


def test_bands(spark):
    rows = spark.createDataFrame([(v,) for v in (8.0, 7.99, 6.0, 4.0, 2.0, 1.99, None)], "v double")
    got = [tuple(r) for r in rows.select(bands.severity_text(F.col("v")), bands.risk_class(F.col("v"))).collect()]
    assert got == [("critical", "risk-critical"), ("high", "risk-high"), ("high", "risk-high"), ("medium", "risk-medium"), ("low", "risk-low"), ("info", "risk-low"), ("info", "risk-low")]
    counts = spark.createDataFrame([(v,) for v in (0, 1, 2, 4, 6, 8, 9)], "n long")
    heat = [r[0] for r in counts.select(bands.heat_band(F.col("n"), F.lit(10))).collect()]
    assert heat == ["commits-0", "commits-1", "commits-1", "commits-2", "commits-3", "commits-4", "commits-high"]


def test_issue_references(spark):
    rows = spark.createDataFrame([("closes #5, issue 7 and #5, fixes  9, Fixes 11",), (None,)], "m string")
    assert [r[0] for r in rows.select(links.issue_references(F.col("m"))).collect()] == [["5", "7", "9"], []]


def test_overall_risk_without_code(spark):
    git = spark.createDataFrame([(1.5,)], "git_risk double")
    found = rk.vulnerability_risk(spark.createDataFrame([], schema.FINDINGS))
    assert rk.overall_risk(git, None, found).first().risk_percent == 15
    assert rk.overall_risk(git, None, found, Options(compat_nan=True)).first().overall_risk == 10.0
