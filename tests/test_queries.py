"""Every analytics query against its SQL, run by DuckDB on the same tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from fluxgauge.plans.queries import QUERIES, SQL  # noqa: E402

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def rows(frame):
    def cell(x):
        if x is None or x != x:
            return ""
        return repr(round(float(x), 6)) if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f" else str(x)

    return sorted(tuple(cell(x) for x in r) for r in frame[sorted(frame)].astype(object).where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, db):
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got) == sorted(want)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or math.isclose(float(u), float(v), abs_tol=1e-5)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)
