"""Every registered query with SQL gives the same rows on DuckDB (smallest tables)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle_check import compare

SQL = entry.oracle_sql()
# fits are covered by tests/test_fit.py; here only what must equal SQL
# no such rows in the smallest tables, in either engine
EMPTY_AT_SMALLEST = {"a3_rare_labels", "h7_exhaustive_cuts", "j2_conflicting_duplicates"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    diff = compare(entry.queries()[name](spark, SF), duck, SQL[name])
    assert diff in ("", "EMPTY") if name in EMPTY_AT_SMALLEST else diff == "", diff


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
