"""Source-code metrics: lines, boundary values, and the pass against a plain loop."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolith.operators import complexity as cx
from chronolith.operators import views as vw
from chronolith.plans import code, report


def metrics(spark, path, content):
    return cx.complexity(spark.createDataFrame([(path, content)], "path string, content string")).first()


@pytest.mark.parametrize(
    ("content", "lines"),
    [(None, []), ("", []), ("\n", [""]), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("a\rb", ["a\rb"])],
)
def test_lines(spark, content, lines):
    rows = spark.createDataFrame([("p", content)], "path string, content string")
    assert [r.text for r in cx.source_lines(rows).orderBy("line_no").collect()] == lines


@pytest.mark.parametrize(
    ("path", "line", "score"),
    [
        ("a.rs", "if x? {", 2.0), ("a.rs", 'if "?" {', 1.0), ("a.rs", "1 => 2, 3 => 4", 1.0), ("a.py", "elif x and y:", 1.5), ("a.py", "[x for x in y]", 1.0),
        ("a.js", "} else if (a ? b : c) {", 2.5), ("a.ts", "switch x", 1.0), ("a.java", "switch x", 0.0), ("a.c", "x = *p++;", 1.5), ("a.c", "*p++;", 0.0), ("a.c", "i++;", 0.5),
        ("a.h", "fgets(x)", 3.0), ("a.c", "x = (char*)(y);", 1.0), ("a.go", "if err != nil {", 2.0), ("a.rb", "x do y { z", 0.5), ("a.rb", "a do b", 0.5),
        ("a.php", "foreach ($a as $b)", 1.0), ("a.cs", "x.Where(y)", 0.5), ("a.c", "// if (x)", 0.0), ("a.c", "#if X", 0.0), ("a", "if for", 1.0), ("a.rs", " if x", 1.0),
    ],
)
def test_cyclomatic(spark, path, line, score):
    assert metrics(spark, path, line).cyclomatic_complexity == 1.0 + score


def test_maintainability_edges(spark):
    assert metrics(spark, "a.rs", None)[1:] == (0.0, 0.0, 0, 0, 0, 0.0)
    assert metrics(spark, "a.rs", "").maintainability_index == 0.0
    assert metrics(spark, "a.rs", "x").maintainability_index == 100.0
    assert 0 < metrics(spark, "a.rs", "x\n" * 100).maintainability_index < 100


def test_binary_like_and_long_text(spark):
    row = metrics(spark, "a.c", "x" * 1_000_000 + "\n{\n}\n")
    assert (row.line_count, row.nesting_depth) == (3, 1)


LINES = ["if (a) {", "}", "} else {", "x();", "for (;;) {", "{ }", "// {", "", "while (x) {", "try {"]


def loop(lines: list[str]) -> tuple[float, int]:
    """The metrics by a plain loop, as the description has them."""
    total, level, depth, deepest = 0.0, 0, 0, 0
    for line in lines:
        if line.endswith("{") or line.startswith(("if ", "for ", "while ")):
            depth += 1
            deepest = max(deepest, depth)
        if line.startswith("}"):
            depth = max(depth - 1, 0)
        if not line or line.startswith("//"):
            continue
        level = max(level + ("{" in line) - ("}" in line), 0)
        hits = ("if " in line) + ("else" in line and "if" not in line) + any(w in line for w in ("for ", "while ", "do ")) + ("try" in line)
        total += hits * (1 + level)
        if "}" in line:
            level = max(level - 1, 0)
    return total, deepest


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=40), min_size=1, max_size=30))
def test_nesting_equals_a_loop(spark, files):
    rows = spark.createDataFrame([(f"{i}.java", "\n".join(x) + "\n" if x else "") for i, x in enumerate(files)], "path string, content string")
    got = {r.path: (r.cognitive_complexity, r.nesting_depth) for r in cx.complexity(rows).collect()}
    assert got == {f"{i}.java": loop(x) for i, x in enumerate(files)}


def test_risk_factors(spark):
    rows = spark.createDataFrame([("a", 15.0, 6), ("b", 15.5, 5), ("c", 26.0, 9)], "path string, cyclomatic_complexity double, nesting_depth long")
    found = cx.risk_factors(rows)
    got = {tuple(r) for r in found.select("path", "factor_type", "severity").collect()}
    assert got == {("a", "DeepNesting", "Medium"), ("b", "HighComplexity", "Medium"), ("c", "HighComplexity", "High"), ("c", "DeepNesting", "Medium")}
    words = {(r.path, r.factor_type): r.description for r in found.collect()}
    assert words["b", "HighComplexity"] == "File b has high cyclomatic complexity (15.5)" and words["c", "HighComplexity"].endswith("(26)")
    assert words["c", "DeepNesting"] == "File c has deep nesting (depth: 9)"
    assert all(r.affected_files == [r.path] and r.recommendation for r in found.collect())


def test_files_that_the_given_metrics_lack_count_too(spark, tmp_path):
    """``file_complexity`` lacks b.rs, and has notes.txt that is no source file; the queries go by ``source_files`` alone."""
    files = [("src/a.rs", "fn a() {\n}\n"), ("src/b.rs", "if x {\n" * 30), ("notes.txt", "if x {\n" * 30)]
    spark.createDataFrame(files, "path string, content string").write.parquet(str(tmp_path / "source_files.parquet"))
    given = spark.createDataFrame([("src/a.rs", 1.0, 1), ("notes.txt", 31.0, 30)], "path string, cyclomatic_complexity double, nesting_depth long")
    given.write.parquet(str(tmp_path / "file_complexity.parquet"))
    paths = lambda query: {r.path for r in query(spark, str(tmp_path)).collect()}
    for query in (code.a17_cyclomatic, code.w2_max_nesting, code.m5_maintainability, report.QUERIES["f11_ext_filter"]):
        assert paths(query) == {"src/a.rs", "src/b.rs"}
    assert paths(code.f6_high_complexity) == paths(code.rf_risk_factors) == {"src/b.rs"}
    assert code.a7_code_risk(spark, str(tmp_path)).first().code_risk == 1.0
    for mode in vw.METRIC_SORTS:
        assert paths(report.QUERIES[f"t9_sort_{mode.replace('-', '_')}"]) == {"src/a.rs", "src/b.rs"}
