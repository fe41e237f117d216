"""Schemas of the tables."""

from __future__ import annotations

COMMITS = (
    "commit_id string, message string, author string, author_email string, committer string, committer_email string, "
    "authored_date timestamp, committed_date timestamp, insertions bigint, deletions bigint, branch string"
)
FILE_CHANGES = "commit_id string, ord int, path string"
BRANCHES = "name string"
SOURCE_FILES = "path string, content string"
PATTERNS = (
    "ord int, name string, pattern string, severity string, category string, description string, cwe string, "
    "examples array<string>"
)
FINDINGS = (
    "commit_id string, commit_message string, author string, date timestamp, files_changed array<string>, "
    "patterns_matched array<string>, risk_score double, cve_references array<string>"
)
COMPLEXITY = (
    "path string, cyclomatic_complexity double, cognitive_complexity double, nesting_depth bigint, "
    "function_count bigint, line_count bigint, maintainability_index double"
)
RISK_FACTORS = "path string, factor_type string, severity string, description string, recommendation string"
DEPENDENCIES = "manifest string, dependencies bigint"
#: always empty: nothing looks up versions, advisories or licences
OUTDATED = "name string, current_version string, latest_version string"
VULNERABLE = "name string, version string, vulnerability string, severity string"
LICENSES = "name string, license string, issue string"
TEST_ANALYSIS = (
    "total_tests bigint, test_directories array<string>, test_frameworks array<string>, has_regression_tests boolean, "
    "test_patterns array<string>"
)
