"""Every registered query equals its DuckDB oracle SQL exactly at sf0.01 (the driver's gate)."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_all_queries_match_oracle(spark):
    from oracle_check import compare
    from slicewatch.plans.catalog import QUERIES
    summary = compare(spark, SF, only=tuple(QUERIES), verbose=False)
    bad = {k: v for k, v in summary.items() if v != "match"}     # every query outside llm has SQL
    assert not bad and set(summary) == set(QUERIES), bad


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
