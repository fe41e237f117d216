"""Commits as a git repository, written by the executors.

One chain of all commits could only be written by one process, and its trees would grow with the table. Here the first
commit is the root, the executors write chains of commits of successive times that start at it, each by one
``git fast-import`` whose pack is moved into the repository, and the last commit joins their tips. A commit differs from its first
parent by its own files alone, and as no two chains share a second, git's date order is the order of the commits.
"""

from __future__ import annotations

import json
import shutil
import subprocess
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("commit_id", "message", "author", "email", "authored", "committed", "paths")
#: commits of a chain; the trees in it grow with its length, while a process and a pack have fixed costs
CHAIN = 5000
#: the repository is only read again, so little packing and no waiting for the disk; long runs of differences make it smaller
SETTINGS = ("-c", "pack.compression=1", "-c", "core.fsync=none", "-c", "fastimport.unpackLimit=0")
DEPTH = 250


def _git(where: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", where, *arguments], check=True, capture_output=True, text=True).stdout.strip()


def _commit(ref: str, row: tuple, parents: Iterable[str] = ()) -> str:
    """A commit in the format of fast-import; its id is its first line and what its files hold. Without parents it goes on from the last one of the ref."""
    commit_id, message, author, email, authored, committed, paths = row
    size = lambda text: len(text.encode("utf-8", "replace"))
    text, named = f"{commit_id}\n\n{message}", size(commit_id)
    joined = "".join(f"{'merge' if i else 'from'} {p}\n" for i, p in enumerate(parents))
    files = "".join(f"M 100644 inline {json.dumps(p, ensure_ascii=False)}\ndata {named}\n{commit_id}\n" for p in paths)
    return f"commit {ref}\nauthor {author} <{email}> {authored} +0000\ncommitter c <c@x> {committed} +0000\ndata {size(text)}\n{text}\n{joined}{files}"


def _import(where: str, ref: str, rows: Iterator[tuple], parents: Iterable[str] = ()) -> str:
    """The id that git gives to the last of the rows, written as a chain whose first commit has the given parents."""
    importing = subprocess.Popen(["git", "-C", where, *SETTINGS, "fast-import", "--quiet", "--date-format=raw", f"--depth={DEPTH}"], stdin=subprocess.PIPE)
    try:
        for row in rows:
            importing.stdin.write(_commit(ref, row, parents).encode("utf-8", "replace"))
            parents = ()
        importing.stdin.close()
    except BrokenPipeError:
        pass
    if importing.wait():
        raise RuntimeError("git could not import the commits")
    return _git(where, "rev-parse", ref)


def _chains(where: str, root: tuple) -> Callable:
    """Writes the rows of a partition as a chain behind the root; gives its newest second and its tip."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True))
        newest = None

        def chain() -> Iterator[tuple]:
            nonlocal newest
            yield root
            for row in rows:
                newest = row[COLUMNS.index("committed")]
                yield row

        # a folder of its own: git looks every object up in all packs of its repository, and an attempt can run beside another one
        own = f"{where}/chains/{uuid.uuid4().hex}"
        try:
            _git(where, "init", "-q", "--bare", own)
            tip = _import(own, "refs/heads/main", chain())
            if newest is not None:
                for pack in sorted(Path(own).glob("objects/pack/pack-*"), key=lambda p: p.suffix == ".idx"):  # a pack is there once its index is
                    pack.rename(f"{where}/objects/pack/{pack.name}")
                yield pa.RecordBatch.from_pydict({"committed": [newest], "tip": [tip]})
        finally:
            shutil.rmtree(own, ignore_errors=True)

    return write


def write_repository(history: DataFrame, where: str) -> None:
    """Writes rows of ``COLUMNS``, seconds for times, one for each commit, to the new folder ``where`` that all executors see; ``main`` is its branch."""
    subprocess.run(["git", "init", "-q", "--bare", "-b", "main", where], check=True)
    place = F.struct("committed", "commit_id")
    first, last, size = history.agg(F.min(place).commit_id, F.max(place).commit_id, F.count("*")).first()
    if not size:
        return
    ends = {r.commit_id: tuple(r) for r in history.where(F.col("commit_id").isin(first, last)).select(*COLUMNS).collect()}
    root = _import(where, "refs/heads/main", iter([ends[first]]))
    if first == last:
        return
    between = history.where(~F.col("commit_id").isin(first, last)).select(*COLUMNS)
    # by range of the second alone, so that all commits of a second are in one chain
    chains = max(history.sparkSession.sparkContext.defaultParallelism, -(-size // CHAIN))
    parts = between.repartitionByRange(chains, "committed").sortWithinPartitions("committed", "commit_id")
    made = parts.mapInArrow(_chains(where, ends[first]), "committed long, tip string").collect()
    tips = [r.tip for r in sorted(made, key=lambda r: -r.committed)]
    _import(where, "refs/heads/main", iter([ends[last]]), tips or [root])
