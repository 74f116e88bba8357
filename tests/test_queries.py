"""Every named query of the document operators against its SQL."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from folioforge.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(agree, name):
    agree(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
