import duckdb
import pytest

import __spark_entry__ as driver
from relspark import queries as relational
from relspark.operators.rows import order_limit

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(relational.oracle_sql()) == set(relational.queries()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(relational.queries()))
def test_like_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = relational.queries()[name](spark, sf)
    want = con.sql(relational.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)

    def plain(v):
        return round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v

    def lines(rows, names):
        at = [names.index(c) for c in order]
        return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)

    assert lines([tuple(r) for r in got.collect()], got.columns) == lines(want.fetchall(), want.columns)


def test_order_nulls_without_a_limit(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS status")
    got = [tuple(r) for r in order_limit(rows, [("status", "desc"), ("o_orderkey", "asc")]).collect()]
    want = duckdb.sql(f"SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM '{sf}/orders.parquet' ORDER BY status DESC NULLS LAST, o_orderkey").fetchall()
    assert got == want and got[0][1] is not None and got[-1][1] is None
