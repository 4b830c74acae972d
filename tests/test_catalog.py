"""Every query of the catalogue against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from searchlight import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.6g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def close(x, y):
    return x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-4, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=key)
    spark.catalog.clearCache()
    if name not in catalog.ORACLE_SQL:
        return
    found = sql.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(all(map(close, a, b)) for a, b in zip(got, want))
