"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from vellum import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return c


def flat(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        v = df[k]
        kinds = {type(x).__name__ for x in v.dropna().iloc[:1]}
        if v.dtype.kind == "f" or "Decimal" in kinds:
            v = v.astype(float).round(6) + 0.0
        v = v.map(lambda x: str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x))
        df[k] = v.replace({"None": "nan", "<NA>": "nan", "NaT": "nan"}).str.replace(r"\.0$", "", regex=True)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    if len(got):
        a, b = flat(got), flat(want)
        assert (a != b).any(axis=1).sum() == 0, (a[(a != b).any(axis=1)].head(), b[(a != b).any(axis=1)].head())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_give_rows(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0
