"""Every query with SQL against DuckDB, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from genoloom.plans import round_trips  # noqa: F401  adds queries
from genoloom.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def plain(df: pd.DataFrame) -> list:
    one = lambda v: None if v is None or v is pd.NaT or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr(tuple(one(getattr(v, "item", lambda: v)()) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLES[name]).df()
    assert plain(got) == plain(want)
