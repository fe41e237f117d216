"""A git repository as tables: a Spark data source named ``git``.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("path", repo).option("table", "commits").load()

Tables are ``commits``, ``file_changes``, ``branches`` and ``remotes``. The ids of the newest ``max_commits`` commits are
listed once; their metadata and files are read by as many tasks as there are batches of ``batch`` commits, each with
one git process. Files are those of the first-parent diff; a root commit has none unless ``include_root`` is set, and a
commit without any difference has those that ``git show`` names. Of a commit the first ``files_per_commit`` files count;
a limit below 0 is none. A batch that fails or takes longer than ``timeout``
seconds is asked for again commit by commit; a commit that still fails has no files, and nothing else is lost.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronolith import schema

_FIELDS = "%H%x1f%an%x1f%ae%x1f%cn%x1f%ce%x1f%at%x1f%ct%x1f%B%x1e"
SCHEMAS = {"commits": schema.COMMITS, "file_changes": schema.FILE_CHANGES, "branches": schema.BRANCHES, "remotes": "ord int, name string, url string"}


def _git(path: str, *arguments: str, given: str | None = None, timeout: int = 600) -> str:
    # bytes, so that line ends stay as they are
    done = subprocess.run(
        ["git", "-C", path, "-c", "core.quotePath=false", *arguments], input=given.encode() if given else None, capture_output=True, timeout=timeout, check=True
    )
    return done.stdout.decode("utf-8", "replace")


class _Batch(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.table = options.get("table", "commits")
        self.batch = int(options.get("batch", 2000))
        self.limit = int(options.get("max_commits", 20_000))
        files = int(options.get("files_per_commit", 20))
        self.files = files if files >= 0 else None
        self.timeout = int(options.get("timeout", 600))
        self.root = str(options.get("include_root", "false")).lower() == "true"

    def partitions(self) -> list[_Batch]:
        if self.table in ("branches", "remotes"):
            return [_Batch([])]
        try:
            ids = _git(self.path, "rev-list", f"--max-count={self.limit}", "--date-order", "HEAD").split()
        except subprocess.CalledProcessError:
            ids = []  # no commit yet
        return [_Batch(ids[i : i + self.batch]) for i in range(0, len(ids), self.batch)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        if self.table == "branches":
            yield from ((name,) for name in _git(self.path, "for-each-ref", "--format=%(refname:short)", "refs/heads").split())
        elif self.table == "remotes":
            for i, name in enumerate(_git(self.path, "remote").split()):
                yield i, name, _git(self.path, "remote", "get-url", name).strip() or None
        elif not partition.ids:
            return
        elif self.table == "commits":
            yield from self._commits("\n".join(partition.ids))
        else:
            yield from self._files(partition.ids)

    def _commits(self, ids: str) -> Iterator[tuple]:
        text = _git(self.path, "log", "--no-walk=unsorted", "--stdin", f"--format={_FIELDS}", given=ids)
        for record in text.split("\x1e"):
            fields = record.lstrip("\n").split("\x1f")
            if len(fields) < 8:
                continue
            commit, author, author_mail, committer, committer_mail, at, ct, message = fields[:8]
            authored, committed = (datetime.fromtimestamp(int(t), UTC) for t in (at, ct))
            yield commit, message.rstrip("\n"), author, author_mail, committer, committer_mail, authored, committed, 0, 0, None

    def _named(self, command: list[str], ids: list[str]) -> dict[str, list[str]]:
        """Commit -> names that a git command tells of it; commits by themselves where it fails on all of them."""
        try:
            text = _git(self.path, *command, "--name-only", "--format=%x1e%H", "-z", given="\n".join(ids) + "\n", timeout=self.timeout)
        except (subprocess.SubprocessError, OSError):
            if len(ids) == 1:
                return {}
            return {c: names for one in ids for c, names in self._named(command, [one]).items()}
        found = {}
        for record in text.split("\x1e"):
            commit, _, rest = record.partition("\0") if "\0" in record[:50] else record.partition("\n")
            names = (n.lstrip("\n") for n in rest.split("\0"))
            # a merge is told of once for every parent, the first one first
            found.setdefault(commit.strip(), [n for n in names if n][: self.files])
        return found

    def _files(self, ids: list[str]) -> Iterator[tuple]:
        flags = ["--root"] if self.root else []
        named = self._named(["diff-tree", "--stdin", "-r", "-m", "--first-parent", "--always", *flags], ids)
        # commits without a difference to their first parent; a root commit is not one of them
        empty = [c for c in ids if c in named and not named[c]]
        rooted = set(_git(self.path, "rev-list", "--max-parents=0", "--stdin", given="\n".join(empty) + "\n").split()) if empty else set()
        again = [c for c in empty if c not in rooted]
        if again:
            named |= self._named(["log", "--no-walk=unsorted", "--stdin", "--cc"], again)
        for commit in ids:
            yield from ((commit, i, n) for i, n in enumerate(named.get(commit, [])))


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def read_git(spark: SparkSession, path: str, table: str = "commits", **options) -> DataFrame:
    """One table of the repository at ``path``; all executors must see the path."""
    if table not in SCHEMAS:
        raise ValueError(f"no table {table}; there are {', '.join(SCHEMAS)}")
    spark.dataSource.register(GitSource)
    reader = spark.read.format("git").option("path", path).option("table", table)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def remote_url(remotes: DataFrame) -> str | None:
    """The address of ``origin``, else of the first remote that has one."""
    row = remotes.where("url is not null").selectExpr("name <> 'origin' as other", "ord", "url").orderBy("other", "ord").first()
    return row["url"] if row else None
