"""Every registered query of the subpackage on the smallest tables; SQL twins where there are any."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from domlens.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import SF
from tools.check_oracle import TABLES, rows_of


def test_all_are_registered():
    registered = E.queries()
    assert set(QUERIES) < set(registered) and "pipeline" in registered
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        found = con.execute(ORACLE[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(columns, found.fetchall())
