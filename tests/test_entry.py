"""Every query runs; those with SQL agree with DuckDB on the smallest tables."""

import importlib.util
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from .conftest import DATA

SQL = entry.oracle_sql()
CORE = importlib.import_module("thicket.plans.core_queries").QUERIES | importlib.import_module("thicket.plans.table_queries").QUERIES


def rows(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        out.append(tuple(None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t[:-8]} as select * from '{folder}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, folder, duck, name):
    got = CORE[name](spark, folder).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    if DATA.exists():
        assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())


def test_core_stands_alone():
    import re
    from pathlib import Path

    root = Path(entry.__file__).parent / "thicket"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
