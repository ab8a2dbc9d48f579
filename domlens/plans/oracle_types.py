"""Output-type discovery for the DuckDB oracle: every query is DESCRIBEd against
empty tables with the test-table schemas, and its DOUBLE / FLOAT / DECIMAL columns
are rounded to 6 places (the Spark side rounds the same columns)."""

from __future__ import annotations

# Schemas of the driver's test tables (FIXTURES.md section 4).
TEST_TABLE_DDL = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, "
                "l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INTEGER",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "benchmark": "item_id BIGINT, text VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
}

_INEXACT = ("DOUBLE", "FLOAT", "REAL", "DECIMAL")


def rounded_oracle(sqls: dict[str, str], digits: int = 6) -> dict[str, str]:
    import duckdb
    con = duckdb.connect()
    for t, ddl in TEST_TABLE_DDL.items():
        con.execute(f"CREATE TABLE {t} ({ddl})")
    out = {}
    for name, sql in sqls.items():
        try:
            cols = con.execute(f"DESCRIBE {sql}").fetchall()
        except Exception:  # noqa: BLE001 - leave the SQL as written
            out[name] = sql
            continue
        inexact = [c[0] for c in cols if str(c[1]).upper().startswith(_INEXACT)]
        if not inexact:
            out[name] = sql
            continue
        rep = ", ".join(f'round(("{c}")::DOUBLE, {digits}) + 0.0 AS "{c}"' for c in inexact)
        out[name] = f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _oracle"
    con.close()
    return out
