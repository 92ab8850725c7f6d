import glob
import os

import duckdb
import pytest

from letterloom.plans import catalogue


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, data, name):
    got = catalogue.QUERIES[name](spark, data)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in got.columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count() >= 0
