"""Git and directory sources, manifests, reports and streams."""

from __future__ import annotations

import json
import subprocess

import pytest

from chronolith.engine import Analysis, analyse_repository, arguments
from chronolith.options import Options
from chronolith.sinks.report import format_of, with_extension, write_report, write_tables
from chronolith.sources.files import read_tree
from chronolith.sources.git import GitReader, read_git, remote_url
from chronolith.sources.manifests import dependency_analysis, dependency_counts, read_manifests
from chronolith.streaming.findings import commits_per_window, once, streaming_findings


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann Ö", "-c", "user.email=a@x.example", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "trunk")
    git("remote", "add", "other", "https://gitlab.example/o.git")
    git("remote", "add", "origin", "git@github.com:lantern/x.git")
    (root / "a.rs").write_text("fn main() {\n    if x {\n    }\n}\n")
    git("add", ".")
    git("commit", "-qm", "first")
    (root / "b é.py").write_text("def f():\n    pass\n")
    (root / "c.py").write_bytes(b"\xff\xfe\x00")
    git("add", ".")
    git("commit", "-qm", "Fix use after free\n\nsee #3")
    return root


def test_git_source(spark, repo):
    commits = {r.message: r for r in read_git(spark, str(repo), batch=1).collect()}
    assert set(commits) == {"first", "Fix use after free\n\nsee #3"}
    assert commits["first"].author == "Ann Ö"
    files = read_git(spark, str(repo), "file_changes").collect()
    assert {(f.commit_id, f.path) for f in files} == {(commits["Fix use after free\n\nsee #3"].commit_id, p) for p in ("b é.py", "c.py")}
    assert read_git(spark, str(repo), "file_changes", include_root=True).count() == 3
    assert [r.name for r in read_git(spark, str(repo), "branches").collect()] == ["trunk"]
    assert remote_url(read_git(spark, str(repo), "remotes")) == "git@github.com:lantern/x.git"
    with pytest.raises(ValueError):
        read_git(spark, str(repo), "tags")


def test_a_failing_commit_has_no_files_and_takes_none_with_it(spark, repo):
    reader = GitReader({"path": str(repo), "table": "file_changes"})
    second = subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    assert {n for _, _, n in reader._files([second, "f" * 40])} == {"b é.py", "c.py"}
    assert list(GitReader({"path": str(repo), "timeout": "0"})._files([second])) == []


def test_files_of_merges_and_empty_commits(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "trunk")
    commits = []
    for branch, name, text in (("trunk", "a.rs", "1"), ("side", "b.rs", "2"), ("trunk", "c.rs", "3")):
        if branch == "side" or len(commits) == 2:
            git("checkout", "-q", *(["-b"] if branch == "side" else []), branch)
        (tmp_path / name).write_text(text)
        git("add", ".")
        git("commit", "-qm", name)
        commits.append(git("rev-parse", "HEAD"))
    git("commit", "-q", "--allow-empty", "-m", "nothing")
    commits.append(git("rev-parse", "HEAD"))
    git("merge", "-q", "--no-ff", "-m", "merge", "side")
    commits.append(git("rev-parse", "HEAD"))
    found = {}
    for r in read_git(spark, str(tmp_path), "file_changes").collect():
        found.setdefault(r.commit_id, []).append(r.path)
    assert found == {commits[1]: ["b.rs"], commits[2]: ["c.rs"], commits[4]: ["b.rs"]}


def test_ignored_files(spark, tmp_path):
    tree = {
        "src/a.py": 1, "src/__init__.py": 1, "src/gen/x.py": 0, "build/y.py": 0, "deep/build/z.py": 0, "keep.log.py": 1, "src/skip_me.py": 0, "src/skip_but.py": 1,
        ".hidden/b.py": 0, ".c.py": 0, "docs/one/two/d.py": 0, "docs/e.py": 1, "lib/only.py": 0, "lib/sub/only.py": 1, "t1.py": 0, "t9.py": 1, "note.md": 0,
    }
    for path in tree:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# rules\n\nbuild/\nskip_*.py\n!skip_but.py\ndocs/**/d.py\nt[1-5].py\n")
    (tmp_path / "src" / ".gitignore").write_text("/gen\n")
    (tmp_path / "lib" / ".ignore").write_text("/only.py\n")
    got = {r.path: r.content for r in read_tree(spark, str(tmp_path), batch=3).collect()}
    assert set(got) == {p for p, kept in tree.items() if kept} and set(got.values()) == {"x = 1\n"}


def test_dependencies_of_a_tree(spark, tmp_path):
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "a"\n# x = 1\n  # y = 2\n')
    (tmp_path / "package.json").write_text('{"a": {"b": "1", "c": "2"}}')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Cargo.toml").write_text("z = 1\n")
    row = dependency_analysis(dependency_counts(read_manifests(spark, str(tmp_path)))).first()
    assert (row.total_dependencies, row.outdated_dependencies, row.license_issues) == (3, [], [])


def test_tree(spark, repo):
    got = {r.path: r.content for r in read_tree(spark, str(repo)).collect()}
    assert got["c.py"] is None
    assert got["a.rs"].startswith("fn main")


def test_manifests(spark):
    rows = spark.createDataFrame([("Cargo.toml", "a = 1\n # b = 2\nc=3"), ("package.json", None), ("x", "a=1")], "path string, content string")
    assert {tuple(r) for r in dependency_counts(rows).collect()} == {("Cargo.toml", 3), ("package.json", 0)}, "an indented comment counts"


@pytest.mark.parametrize("kind", ["html", "JSON"])
def test_report(spark, repo, tmp_path, kind):
    where = analyse_repository(spark, str(repo), str(tmp_path / "out"), Options(patterns="all", output=kind))
    text = open(where, encoding="utf-8").read()
    assert "Use After Free" in text
    assert where.endswith(kind.lower())
    if kind == "JSON":
        report = json.loads(text)
        assert report["risk"][0]["overall_risk"] <= 10
        assert report["totals"] == [{"total_lines": 6, "total_files": 3}] and report["dependencies"][0]["total_dependencies"] == 0
    else:
        assert "<section id='heatmap' data-size=50>" in text and "<select data-column='extension'>" in text and "id='dependencies'" in text


def test_tables_as_json(spark, repo, tmp_path):
    tables = Analysis(read_git(spark, str(repo)), read_git(spark, str(repo), "file_changes")).tables()
    write_tables({"top": tables["top_contributors"]}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "top")).first()["commits"] == 2


def test_a_report_has_all_rows(spark, tmp_path):
    rows = spark.range(2500).selectExpr("id", "concat('p', id) as path", "cast(null as string) as owner").orderBy("id")
    tables = {"heatmap": rows, "stats": rows.limit(0)}
    page = open(write_report(tables, str(tmp_path / "r"), "html", include_stats=True), encoding="utf-8").read()
    assert page.count("<tr>") == 2501 and "<td>p2499</td>" in page and "No rows." in page
    text = open(write_report(tables, str(tmp_path / "r"), "json"), encoding="utf-8").read()
    want = {"heatmap": [{"id": k, "path": f"p{k}", "owner": None} for k in range(2500)], "stats": []}
    assert text == json.dumps(want, indent=2)


def test_formats():
    assert [format_of(x) for x in ("HTML", "json", "pdf")] == ["html", "json", "html"]
    assert with_extension("a", "json") == "a.json" and with_extension("a.html", "html") == "a.html"
    assert arguments(["-r", "x"]).stale_days == 365


def test_streams(spark, tmp_path):
    source, schema = tmp_path / "in", "commit_id string, message string, author string, committed_date timestamp, files_changed array<string>"
    rows = [("1", "uaf", "a", "2024-01-01 00:00:00", ["x"]), ("1", "uaf", "a", "2024-01-01 00:00:00", ["x"]), ("2", "no", None, "2024-01-02 00:00:00", None), ("3", "xss", "b", "2024-01-20 00:00:00", None)]
    frame = spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr("commit_id", "message", "author", "to_timestamp(committed_date) committed_date", "files_changed")
    frame.write.parquet(str(source))

    def run(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    stream = lambda: spark.readStream.schema(schema).parquet(str(source))
    found = run(streaming_findings(once(stream())), "append", "found")
    assert sorted((f[0], f[4]) for f in found) == [("1", 9.0), ("3", 0.0)]
    counts = run(commits_per_window(once(stream()), late=None), "append", "counts")
    assert all(len(c) == 4 for c in counts)
