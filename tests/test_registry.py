"""Every query of the core against its SQL in DuckDB, over the same Parquet tables."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandlake.plans import registry


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _text(v):
    if v is None or v is pd.NA or v != v:
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.number, decimal.Decimal)):
        return repr(round(float(v), 6))
    return repr(bytes(v)) if isinstance(v, (bytes, bytearray)) else str(v)


def rows(df):
    return sorted(tuple(_text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, db, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
