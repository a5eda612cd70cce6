"""Every query of the catalog with SQL against DuckDB on the smallest tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from lectern.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def result(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = result(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert got == result(names, found.fetchall())
    else:
        assert got[1]
