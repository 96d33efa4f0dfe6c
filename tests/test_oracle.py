"""Every registered query against its SQL twin, over whole tables."""

import pytest

from answerloom.catalog import load
from oracle import ROOT, compare

ENTRIES = load()


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is not None])
def test_equals_sql(spark, name):
    problem = compare(spark, ENTRIES[name], f"{ROOT}/sf0.001")
    assert problem in (None, "EMPTY"), problem


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is None])
def test_runs(spark, name):
    assert ENTRIES[name].run(spark, f"{ROOT}/sf0.001").count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {r.subset for r in entry.entry(spark).collect()} >= {None, "A", "N", "R"}
