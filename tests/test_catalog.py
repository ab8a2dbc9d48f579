"""Every registered query against its DuckDB twin on the smallest test tables
(the driver's check at sf0.01 is the same comparison, see tools/check_oracle.py)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from domlens.plans import catalog
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

catalog.load_all()
QUERIES = {n: q for n, q in E.queries().items() if n in catalog.QUERIES}
ORACLE = {n: q for n, q in E.oracle_sql().items() if n in catalog.QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 1 and "suffix" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, res.fetchall())


def test_only_model_scores_have_no_oracle():
    assert set(QUERIES) == set(catalog.QUERIES) and all(q.__doc__ for q in QUERIES.values())
    rows_only = sorted(set(QUERIES) - set(ORACLE))
    assert all(n.startswith("M") for n in rows_only), rows_only


@pytest.mark.parametrize("name", ["M3_logistic_regression_seeds", "M5_decision_tree", "M9_gaussian_nb", "M14_M15_scoring"])
def test_model_query_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(v is not None for v in rows[0])
