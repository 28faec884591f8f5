"""Every catalogued query runs, isn't empty, and equals its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillon.plans import casework, intake, library, passages, searches, stores  # noqa: F401
from quillon.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def shown(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    out = QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    rows = sorted(tuple(shown(v) for v in r) for r in out.select(*columns).collect())
    assert rows
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall()) == rows


def test_dense_filter_reaches_the_scan(spark, sf):
    plan = QUERIES["dense_topk_threshold_filtered"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan
