"""Every query with SQL against DuckDB: exact columns equal, numbers to nine digits."""

import decimal
import math

import duckdb
import pytest

from heatloom.plans import catalog
from tests.conftest import SF

#: Tables with enough rows for rare cases.
DIRS = [SF.replace("sf0.001", "sf0.01")]
#: Queries without SQL are tested on fixtures: test_operators.py.
NO_SQL = {"agg_bootstrap_ci", "graph_preferred", "graph_pairs", "graph_snap"}


@pytest.fixture(scope="module", params=DIRS)
def duck(request):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{request.param}/{t}.parquet'")
    return con, request.param


def plain(x):
    return float(x) if isinstance(x, (decimal.Decimal, float)) else x


def close(x, y):
    if isinstance(x, float) or isinstance(y, float):
        if x is None or y is None:
            return x is y
        return x == y or math.isnan(x) and math.isnan(y) or abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    return x == y


def sortable(row, floats):
    """Exact columns first, then floats, rounded: rows that differ only in a float's last digits keep their order."""
    return [str(v) for v, f in zip(row, floats) if not f], [(v is None, round(v or 0.0, 5)) for v, f in zip(row, floats) if f]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    con, sf = duck
    df = catalog.queries()[name](spark, sf)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = [tuple(map(plain, r)) for r in df.select(names).collect()]
    want = [tuple(map(plain, r)) for r in want.fetchall()]
    assert len(got) == len(want)
    floats = [any(isinstance(r[i], float) for r in got + want) for i in range(len(names))]
    for rows in (got, want):
        rows.sort(key=lambda r: sortable([float(v) if f and v is not None else v for v, f in zip(r, floats)], floats))
    for a, b in zip(got, want):
        assert all(map(close, a, b)), (a, b)
    assert got, "the query says something"


def test_all_others_are_named():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == NO_SQL
