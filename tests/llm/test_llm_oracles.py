"""Every query of the subpackage that SQL can express gives the rows of its SQL."""

import pytest

from reelsift.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, same_as_sql, folder):
    assert same_as_sql(queries.QUERIES[name], queries.ORACLES[name], folder)
