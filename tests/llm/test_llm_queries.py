"""Queries with SQL against DuckDB, and the pipeline stage by stage, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from genoloom.llm import decontam, icws
from genoloom.llm.common import stored, table
from genoloom.llm.entries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def plain(df) -> list:
    one = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr(tuple(one(getattr(v, "item", lambda: v)()) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert plain(QUERIES[name](spark, DIR).toPandas()) == plain(con.execute(ORACLES[name]).df())


def test_pipeline(spark):
    docs = table(spark, DIR, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DIR))
        if name != "mixture":
            assert docs.columns == columns and 0.5 * n < docs.count() <= before.count()
        if name == "near_duplicates":
            assert icws.near_duplicates(docs).filter("doc_id <> class_id").isEmpty()
        if name == "decontamination":
            assert decontam.contaminated(docs, table(spark, DIR, "benchmark")).isEmpty()
    assert docs.columns == [*columns, "copy", "mix_rate"]
    assert set(QUERIES) == {f"op{k}_{x}" for k, x in enumerate("lm_score quotations decontamination language mixture quality rules substrings tokens near_duplicates".split(), 1)}
