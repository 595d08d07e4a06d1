"""Every query of the engine against its SQL, on the smallest tables; queries without SQL must give rows."""

import pytest

from oracle import database, rows
from tessella.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, con, name):
    got = QUERIES[name](spark, small).toArrow()
    want = con.execute(SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


#: Rows at sf0.001 of the queries without SQL, where every input row gives one; the rest give some.
ROWS = {"a12_robust_mean": None, "t02_population": "customer", "t04_poisson_arrivals": "orders", "r09_smooth_surface": None}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, con, name):
    got = QUERIES[name](spark, small).toArrow()
    assert got.num_rows > 0
    assert all(got.column(c).null_count < got.num_rows for c in got.column_names)
    if ROWS.get(name):
        assert got.num_rows == con.execute(f"SELECT count(*) FROM {ROWS[name]}").fetchone()[0]


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
