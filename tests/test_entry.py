"""The driver's entry points."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(map(callable, queries.values()))


def test_a_missing_module_is_left_out_and_a_broken_one_is_not(tmp_path, monkeypatch):
    assert entry._optional("chronolith.nothing.at_all") is None
    (tmp_path / "broken_module.py").write_text("import no_such_thing_at_all\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ImportError):
        entry._optional("broken_module")
