"""Every registered risk query against its DuckDB counterpart."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
FAST = [n for n in catalog.ORACLE_SQL if n not in ("hs_var_es_1000",)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if c in ("date", "hour", "start", "end", "band_end"):
            df[c] = pd.to_datetime(df[c])
        elif df[c].dtype == object and c not in ("series_id", "model", "test", "band", "as_interpretation"):
            df[c] = pd.to_numeric(df[c])
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, con, name):
    got, want = _plain(catalog.QUERIES[name](spark, SF).toPandas()), _plain(con.execute(catalog.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-6)
