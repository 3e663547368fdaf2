"""Every registered engine query against its SQL, at the smallest scale."""

import math
import os

import pytest

from quillseek.queries import engine_queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(names, rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(engine_queries()))
def test_same_rows_as_sql(spark, duck, name):
    query, sql = engine_queries()[name]
    df = query(spark, DATA)
    want = duck.sql(sql)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(want.columns, want.fetchall())


@pytest.mark.parametrize(("name", "rows"), [("s_group", "part"), ("s_nulls", "orders"), ("s_nested", "(SELECT DISTINCT l_orderkey FROM lineitem)"), *[(n, "part") for n in ("s_form", "s_sub_field", "s_keyword")], *[(n, "orders") for n in ("s_unmapped", "s_override", "s_relational")], ("s_geo", "customer")])
def test_whole_order_as_sql(spark, duck, name, rows):
    query, sql = engine_queries()[name]
    got = [tuple(r) for r in query(spark, DATA).collect()]
    assert got == duck.sql(sql).fetchall() and len(got) == duck.sql(f"SELECT count(*) FROM {rows}").fetchall()[0][0]
    assert name != "s_nulls" or len({r[0] is None for r in got}) == 2


def test_coalesced_tests_reach_all_orders(spark, duck):
    query, _ = engine_queries()["n_coalesced"]
    got = {r.l_orderkey for r in query(spark, DATA).collect()}
    apart = duck.sql("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 3 AND bool_or(l_quantity > 45) AND bool_or(l_returnflag = 'R')").fetchall()
    assert max(got) >= 1000 and got < {k for (k,) in apart}
