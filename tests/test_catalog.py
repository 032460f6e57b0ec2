import pytest

import __spark_entry__ as entry_module
from tidewater.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(name, agree):
    agree(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_reference_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
