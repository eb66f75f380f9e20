"""Every query with SQL gives DuckDB's rows; every other one runs."""

import duckdb
import pytest

from isobath.plans import registry
from isobath.sources.views import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted([tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else repr(r[i]) for i in at) for r in rows])


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    rows, columns = found.collect(), sorted(found.columns)
    if name in registry.SQL:
        cursor = duck.execute(registry.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert plain(rows, found.columns, columns) == plain(cursor.fetchall(), names, columns)


def test_entry_has_rows(spark):
    assert registry.entry(spark, SF).count() > 0
