"""Every query with SQL against DuckDB, on whole tables."""

import pytest
from harness import compare

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    assert compare(spark, name, entry, sf) == ""


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_period_years_holds_every_year_of_growth(spark, sf):
    got = {(r.ticker, y) for r in entry.queries()["period_years"](spark, sf).collect() for y in r.years}
    assert got == {(r.ticker, r.year) for r in entry.queries()["growth"](spark, sf).collect()}
    assert any(y not in range(1996, 2001) for _, y in got)
