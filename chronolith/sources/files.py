"""A directory tree as ``source_files``: a Spark data source named ``tree``.

Only paths are listed in the driver; files are read by as many tasks as there are batches of ``batch`` paths. Hidden
files and folders, and what ``.gitignore`` and ``.ignore`` files exclude, are left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronolith.functions.paths import extension
from chronolith.operators.complexity import ANALYSED

# Extensions of binary files.
BINARY = ("exe", "dll", "so", "dylib", "bin", "o", "obj", "lib", "a", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "jpg", "jpeg", "png", "gif",
          "bmp", "ico", "tiff", "mp3", "mp4", "avi", "mov", "wav", "pdf", "doc", "docx")
#: files that hold rules, the later ones win
RULES = (".gitignore", ".ignore")


def is_binary(path: Column, content: Column) -> Column:
    """By extension, or by a zero byte among the first 1,024."""
    nul = F.contains(F.substring(content, 1, 1024), F.lit(b"\x00"))
    return F.coalesce(F.lower(extension(path)).isin(*BINARY), F.lit(False)) | F.coalesce(nul, F.lit(False))


class Rule:
    """One line of an ignore file: what it matches below the file's folder, and whether it takes an exclusion back."""

    def __init__(self, line: str):
        self.back = line.startswith("!")
        body = line[1:] if self.back else line
        self.folders = body.endswith("/")
        body = body.rstrip("/")
        anchored = "/" in body
        self.regex = re.compile(("" if anchored else "(?:.*/)?") + self._translated(body.lstrip("/")))

    @staticmethod
    def _translated(glob: str) -> str:
        pieces = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        parts = re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]/]+\]|\\.)", glob)
        out = []
        for part in parts:
            if part.startswith("[") and part.endswith("]") and len(part) > 2:
                out.append(part.replace("[!", "[^", 1))
            elif part.startswith("\\") and len(part) == 2:
                out.append(re.escape(part[1]))
            else:
                out.append(pieces.get(part) or re.escape(part))
        return "".join(out)

    def matches(self, path: str, folder: bool) -> bool:
        return (folder or not self.folders) and self.regex.fullmatch(path) is not None


def read_rules(folder: str) -> list[Rule]:
    rules = []
    for name in RULES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as file:
                lines = [x.rstrip("\r\n") for x in file]
        except OSError:
            continue
        rules += [Rule(x.rstrip() if not x.endswith("\\ ") else x) for x in lines if x.strip() and not x.startswith("#")]
    return rules


def walk(root: str) -> Iterator[str]:
    """Paths below ``root``, in order, of all regular files that are neither hidden nor ignored. Links are not followed."""

    def ignored(scopes: list[tuple[str, list[Rule]]], path: str, folder: bool) -> bool:
        for base, rules in reversed(scopes):
            below = path[len(base) + 1 :] if base else path
            for rule in reversed(rules):
                if rule.matches(below, folder):
                    return not rule.back
        return False

    def inside(folder: str, scopes: list[tuple[str, list[Rule]]]) -> Iterator[str]:
        full = os.path.join(root, folder) if folder else root
        rules = read_rules(full)
        scopes = [*scopes, (folder, rules)] if rules else scopes
        for entry in sorted(os.scandir(full), key=lambda e: e.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.name.startswith(".") or entry.is_symlink() or ignored(scopes, path, entry.is_dir()):
                continue
            if entry.is_dir():
                yield from inside(path, scopes)
            elif entry.is_file():
                yield path

    return inside("", [])


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.endings = set(options.get("extensions", ",".join(ANALYSED)).split(","))
        self.batch = int(options.get("batch", 500))

    def partitions(self) -> list[_Paths]:
        wanted = [p for p in walk(self.root) if "." in p.rsplit("/", 1)[-1][1:] and p.rsplit(".", 1)[-1] in self.endings]
        return [_Paths(wanted[i : i + self.batch]) for i in range(0, len(wanted), self.batch)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as file:
                    yield path, file.read()
            except OSError:
                yield path, None  # it went or may not be read: a row of zero metrics


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = ANALYSED, **options) -> DataFrame:
    """``path`` (below ``root``) and ``content`` of the files with these extensions; all executors must see ``root``.

    Binary files and files that are not UTF-8 have a null content, so they keep a row of zero metrics.
    """
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("path", root).option("extensions", ",".join(extensions))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    rows = reader.load()
    text = F.when(~is_binary(F.col("path"), F.col("content")) & F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))
    return rows.select("path", text.alias("content"))
