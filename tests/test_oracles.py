"""Every registered frame-selection query gives the rows of its SQL."""

import pytest

from reelsift.plans import catalog, frame_catalog  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, same_as_sql, folder):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLES[name], folder)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
