"""Every query with SQL equals it on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from lexkeel.plans import catalog, catalog_sources, catalog_synthetic, catalog_theses  # noqa: F401
from lexkeel.schemas import TABLES

SF = Path("/root/testdata/sf0.001")


def value(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) else round(v, 9))
    return v


@pytest.fixture(scope="module")
def con():
    if not SF.is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(catalog.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(value(r[i]) for i in at) for r in res.fetchall()), key=str)
    assert got
