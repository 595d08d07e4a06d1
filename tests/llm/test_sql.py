"""The queries of the subpackage that SQL can express, against it."""

import pytest

from oracle import database, rows
from tessella.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    assert rows(QUERIES[name](spark, small).toArrow()) == rows(database(small).execute(SQL[name]).to_arrow_table())
