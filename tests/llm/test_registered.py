"""The queries of this package are among the driver's."""

from __future__ import annotations

import __spark_entry__ as entry
from chronolith.llm import catalogue


def test_all_queries_are_registered():
    assert set(catalogue.queries()) <= set(entry.queries()) and set(catalogue.oracles()) <= set(entry.oracle_sql())
    found = {"p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p7_found", "p8_ids", "p9_mix", "p10_found"}
    assert found <= set(catalogue.queries())
