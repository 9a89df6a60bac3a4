"""Every query with SQL is held against it on the smallest tables."""

import math
import os

import pytest

from touchline.plans import brackets, decisions, files, fitted, forecasting, matching, reports, squads, styles  # noqa: F401  they add their queries
from touchline.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = duck.execute(ORACLES[name])
    at = [[x[0] for x in r.description].index(c) for c in cols]
    expected = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert all(x == y or (isinstance(x, float) and y is not None and math.isclose(x, float(y), rel_tol=1e-6, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)
