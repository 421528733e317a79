"""Every query with SQL must give the same rows in DuckDB, on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from vigilar.workload import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(pdf):
    def clean(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v

    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(clean(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) - len(ORACLES) <= 11


@pytest.mark.parametrize("name", ["suite_results", "drift_results", "fsl_results", "stream_scores_lof"])
def test_rows_only_queries(rows_of_query, name):
    out = rows_of_query(name)
    assert len(out) > 0
    if name == "suite_results":
        assert len(out) == 24 and out["roc_auc"].dropna().between(0, 1).all()
    if name == "fsl_results":
        assert len(out) == 4 * (7 * 5 + 1)


def test_optional_queries_are_registered_beside_these():
    import __spark_entry__ as entry_point

    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())
