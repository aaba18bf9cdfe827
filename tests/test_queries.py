"""Every query with SQL gives the rows that DuckDB gives, on whole tables."""

import duckdb
import pytest

from driftsieve import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "row_band_keys index_keys ledger shards paths documents input_parquet".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_each_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_rows_equal(spark, duck, name):
    got = core.queries()[name](spark, DATA)
    want = duck.sql(core.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda r: sorted(map(repr, r))
    assert rows(tuple(x) for x in got.select(*columns).collect()) == rows(want.select(*columns).fetchall())
