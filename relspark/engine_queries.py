"""Registered queries that go through the engine: statements on tables of its own, then what these hold."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import CatalogProblem
from relspark.constraints import Violation
from relspark.engine import Engine
from relspark.sources.files import load, read, write

_STEPS: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function of an engine and a reader of the given tables under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        _STEPS[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """The folder set in ``spark.checkpoint.dir``; one of our own only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = f"file://{tempfile.mkdtemp(prefix='relspark-')}"
    return base


def _run(spark: SparkSession, sf_dir: str, steps: Callable) -> DataFrame:
    engine = Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}")
    return steps(engine, partial(load, spark, sf_dir))


def _refused(call: Callable, *args) -> bool:
    try:
        call(*args)
    except (Violation, CatalogProblem):
        return True
    return False


def _table(engine: Engine, name: str, rows: DataFrame) -> None:
    """A table made from rows, as CREATE TABLE AS makes one from a query."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString().replace('_ntz', '')}" for f in rows.schema)
    engine.sql(f"CREATE TABLE {name} ({columns})")
    engine.insert_rows(name, rows)


_NATION = "CREATE TABLE nation_copy (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25) NOT NULL, n_regionkey INT)"


# -- transactions


@query("SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN upper(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey < 2 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey < 20")
def txn_commit(engine, t):
    engine.sql(_NATION)
    engine.insert_rows("nation_copy", t("nation"))
    engine.sql("BEGIN; UPDATE nation_copy SET n_name = upper(n_name), n_regionkey = n_regionkey + 10 WHERE n_regionkey < 2; DELETE FROM nation_copy WHERE n_nationkey >= 20; COMMIT")
    return engine.table("nation_copy")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def txn_rollback(engine, t):
    engine.sql(_NATION)
    engine.insert_rows("nation_copy", t("nation"))
    engine.sql("BEGIN; DELETE FROM nation_copy; INSERT INTO nation_copy VALUES (1, 'x', 1); ROLLBACK")
    return engine.table("nation_copy")


@query("SELECT 'before' AS state, count(*) AS n FROM nation UNION ALL SELECT 'now', count(*) FROM nation WHERE n_regionkey <> 1")
def history_read(engine, t):
    engine.sql(_NATION)
    engine.insert_rows("nation_copy", t("nation"))
    version = engine.stats()["version"]
    engine.sql("DELETE FROM nation_copy WHERE n_regionkey = 1")
    engine.vacuum()
    old, new = engine.table_at("nation_copy", version), engine.table("nation_copy")
    return old.agg(F.count("*").alias("n")).select(F.lit("before").alias("state"), "n").unionByName(new.agg(F.count("*").alias("n")).select(F.lit("now").alias("state"), "n"))


# -- databases and names


@query("SELECT r.r_regionkey AS id, n.n_name AS name, r.r_name AS region FROM region r JOIN nation n ON r.r_regionkey = n.n_nationkey")
def sql_two_databases(engine, t):
    engine.sql("CREATE DATABASE a; CREATE DATABASE b; CREATE TABLE a.u (id INT, name TEXT); CREATE TABLE b.u (id INT, name TEXT)")
    engine.insert_rows("a.u", t("region").toDF("id", "name"))
    engine.insert_rows("b.u", t("nation", "n_nationkey", "n_name").toDF("id", "name"))
    return engine.query_text("SELECT x.id, y.name, x.name AS region FROM a.u x, b.u y WHERE x.id = y.id")


@query("SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1")
def use_database(engine, t):
    engine.sql("CREATE DATABASE shop; CREATE TABLE n (k INT); INSERT INTO n VALUES (99); USE shop; CREATE TABLE n (k INT)")
    engine.insert_rows("n", t("nation").select(F.col("n_regionkey").alias("k")))
    return engine.query_text("SELECT n.k, count(*) AS n FROM shop.n GROUP BY n.k")


@query("SELECT 'table' AS kind, true AS refused UNION ALL SELECT 'view', true UNION ALL SELECT 'database', true")
def drop_table_gone(engine, t):
    engine.sql("CREATE DATABASE d; CREATE TABLE d.gone (r_regionkey INT, r_name TEXT); CREATE VIEW seen AS SELECT * FROM d.gone")
    engine.insert_rows("d.gone", t("region"))
    engine.query_text("SELECT * FROM d.gone").count()
    engine.sql("DROP TABLE d.gone")
    found = [("table", _refused(engine.sql, "SELECT * FROM d.gone")), ("view", _refused(engine.sql, "SELECT * FROM seen"))]
    engine.sql("DROP DATABASE d")
    found.append(("database", _refused(engine.sql, "CREATE TABLE d.again (a INT)")))
    return engine.spark.createDataFrame(found, "kind string, refused boolean")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F'")
def create_table_as(engine, t):
    _table(engine, "o", t("orders", "o_orderkey", "o_totalprice", "o_orderstatus"))
    engine.sql("CREATE TABLE finished AS SELECT o_orderkey, o_totalprice * 2 AS twice FROM o WHERE o_orderstatus = 'F'")
    return engine.table("finished")


# -- rows


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderpriority END AS note FROM orders")
def insert_select(engine, t):
    _table(engine, "o", t("orders", "o_orderkey", "o_custkey", "o_orderpriority"))
    engine.sql("CREATE TABLE kept (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT NOT NULL, note TEXT DEFAULT 'none')")
    engine.sql("INSERT INTO kept SELECT * FROM o WHERE o_orderkey % 3 <> 0; INSERT INTO kept (o_custkey, o_orderkey) SELECT o_custkey, o_orderkey FROM o WHERE o_orderkey % 3 = 0")
    return engine.table("kept")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_rows(engine, t):
    _table(engine, "o", t("orders", "o_orderkey", "o_totalprice", "o_orderstatus"))
    engine.sql("UPDATE o SET o_orderstatus = 'X', o_totalprice = o_totalprice + 1 WHERE o_orderstatus = 'F'")
    return engine.table("o")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_by_subquery(engine, t):
    _table(engine, "o", t("orders", "o_orderkey", "o_custkey"))
    _table(engine, "c", t("customer", "c_custkey", "c_mktsegment"))
    engine.sql("DELETE FROM o WHERE o_custkey IN (SELECT c_custkey FROM c WHERE c_mktsegment = 'BUILDING')")
    return engine.table("o")


@query("SELECT 'delete' AS statement, count(*) AS rows_affected FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'insert', count(*) FROM nation UNION ALL SELECT 'truncate', count(*) FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'update', count(*) FROM nation WHERE n_regionkey < 2")
def rows_affected(engine, t):
    engine.sql(_NATION)
    counts = [("insert", engine.insert_rows("nation_copy", t("nation")).rows_affected)]
    for kind, text in (("update", "UPDATE nation_copy SET n_name = 'x' WHERE n_regionkey < 2"), ("delete", "DELETE FROM nation_copy WHERE n_regionkey = 2"), ("truncate", "TRUNCATE TABLE nation_copy")):
        counts.append((kind, engine.sql(text).rows_affected))
    return engine.spark.createDataFrame(counts, "statement string, rows_affected long")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'changed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 1")
def rows_by_place(engine, t):
    _table(engine, "r", t("region"))
    ids = {r["r_regionkey"]: r["row_id"] for r in engine.rows_with_ids("r").collect()}
    assert engine.fetch("r", ids[0])["r_regionkey"] == 0
    engine.update_row("r", ids[0], {"r_name": "changed"})
    ids = {r["r_regionkey"]: r["row_id"] for r in engine.rows_with_ids("r").collect()}
    engine.delete_row("r", ids[1])
    return engine.table("r")


@query("SELECT n_nationkey, n_name FROM nation")
def compact_parts(engine, t):
    engine.sql("CREATE TABLE n (n_nationkey INT, n_name TEXT)")
    for k in range(4):
        engine.insert_rows("n", t("nation", "n_nationkey", "n_name").filter(F.col("n_nationkey") % 4 == k))
    engine.compact("n")
    return engine.table("n")


@query("SELECT 3 AS n, 3 AS numbers, 'abc' AS label, 1 AS given")
def defaults_and_numbers(engine, t):
    engine.sql("CREATE TABLE d (id BIGINT AUTO_INCREMENT PRIMARY KEY, label VARCHAR(3) DEFAULT 'abc', given INT); INSERT INTO d (given) VALUES (1), (NULL); INSERT INTO d (label) VALUES (DEFAULT)")
    return engine.query_text("SELECT CAST(count(*) AS INT) AS n, CAST(count(DISTINCT id) AS INT) AS numbers, max(label) AS label, max(given) AS given FROM d WHERE id > 0")


@query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey = 4 THEN 9 ELSE 7 END AS extra FROM region")
def alter_add_column(engine, t):
    _table(engine, "r", t("region").filter("r_regionkey < 4"))
    engine.sql("ALTER TABLE r ADD COLUMN extra INT DEFAULT 7")
    engine.insert_rows("r", t("region").filter("r_regionkey = 4").withColumn("extra", F.lit(9)))
    return engine.table("r")


@query("SELECT count(*) AS n FROM region WHERE r_regionkey > 2")
def truncate_and_refill(engine, t):
    _table(engine, "r", t("region"))
    engine.sql("TRUNCATE TABLE r")
    engine.insert_rows("r", t("region").filter("r_regionkey > 2"))
    return engine.query_text("SELECT count(*) AS n FROM r")


@query("SELECT n_regionkey / 2 AS x FROM nation WHERE false UNION ALL SELECT (n_regionkey + 1) // 2 // 2 FROM nation WHERE n_nationkey // 2 = 3")
def int_division_shapes(engine, t):
    engine.sql(_NATION)
    engine.insert_rows("nation_copy", t("nation"))
    return engine.query_text("WITH h AS (SELECT (n_regionkey + 1) / 2 AS x, n_nationkey AS k FROM nation_copy) SELECT CAST(y / 2 AS DOUBLE) AS x FROM (SELECT x AS y, k FROM h) WHERE k / 2 = 3")


# -- views


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def view_follows_table(engine, t):
    rows = t("customer", "c_custkey", "c_mktsegment", "c_acctbal")
    _table(engine, "c", rows.filter("c_custkey % 2 = 0"))
    engine.sql("CREATE VIEW good AS SELECT c_custkey, c_mktsegment FROM c WHERE c_acctbal > 0; CREATE VIEW per_segment (segment, n) AS SELECT c_mktsegment, count(*) FROM good GROUP BY c_mktsegment")
    engine.query_text("SELECT * FROM per_segment").count()
    engine.insert_rows("c", rows.filter("c_custkey % 2 = 1"))
    return engine.query_text("SELECT * FROM per_segment")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def view_replaced(engine, t):
    _table(engine, "n", t("nation"))
    _table(engine, "r", t("region"))
    engine.sql("CREATE VIEW v AS SELECT 1 AS one; CREATE OR REPLACE VIEW v AS SELECT n.n_name, r.r_name FROM n JOIN r ON n.n_regionkey = r.r_regionkey")
    return engine.query_text("SELECT * FROM v WHERE r_name LIKE 'A%'")


# -- keys, indexes


@query("SELECT 'check' AS rule, true AS refused UNION ALL SELECT 'foreign', true UNION ALL SELECT 'length', true UNION ALL SELECT 'null', true UNION ALL SELECT 'primary', true UNION ALL SELECT 'restrict', true UNION ALL SELECT 'unique', true")
def constraints_refuse(engine, t):
    engine.sql(
        "CREATE TABLE r (r_regionkey INT PRIMARY KEY, r_name VARCHAR(25) NOT NULL UNIQUE, CHECK (r_regionkey >= 0));"
        "CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT REFERENCES r (r_regionkey))"
    )
    engine.insert_rows("r", t("region"))
    engine.insert_rows("n", t("nation"))
    bad = {
        "check": "INSERT INTO r VALUES (-1, 'x')", "foreign": "INSERT INTO n VALUES (99, 'x', 99)", "length": f"INSERT INTO r VALUES (9, '{'x' * 26}')", "null": "INSERT INTO r VALUES (9, NULL)",
        "primary": "INSERT INTO r VALUES (1, 'x')", "restrict": "DELETE FROM r WHERE r_regionkey = 1", "unique": "UPDATE r SET r_name = 'ASIA' WHERE r_regionkey = 0",
    }
    return engine.spark.createDataFrame([(k, _refused(engine.sql, v)) for k, v in bad.items()], "rule string, refused boolean")


@query("SELECT n_nationkey, n_name, CASE WHEN r_name = 'EUROPE' THEN n_regionkey + 100 ELSE n_regionkey END AS n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT LIKE 'A%'")
def dml_cascade(engine, t):
    engine.sql("CREATE TABLE r (r_regionkey INT PRIMARY KEY, r_name TEXT); CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT REFERENCES r (r_regionkey) ON DELETE CASCADE ON UPDATE CASCADE)")
    engine.insert_rows("r", t("region"))
    engine.insert_rows("n", t("nation"))
    engine.sql("DELETE FROM r WHERE r_name LIKE 'A%'; UPDATE r SET r_regionkey = r_regionkey + 100 WHERE r_name = 'EUROPE'")
    return engine.table("n")


@query("""
SELECT 'cascade' AS rule, n_nationkey AS k, n_regionkey AS parent FROM nation WHERE n_regionkey >= 2
UNION ALL SELECT 'null', n_nationkey, CASE WHEN n_regionkey < 2 THEN NULL ELSE n_regionkey END FROM nation
UNION ALL SELECT 'refused', 1, 1""")
def fk_cross_database(engine, t):
    engine.sql(
        "CREATE DATABASE a; CREATE DATABASE b; CREATE TABLE a.r (id INT PRIMARY KEY); CREATE TABLE b.r (id INT PRIMARY KEY);"
        "CREATE TABLE b.casc (k INT, parent INT REFERENCES a.r (id) ON DELETE CASCADE); CREATE TABLE b.nulled (k INT, parent INT REFERENCES a.r (id) ON DELETE SET NULL);"
        "CREATE TABLE b.own (k INT, parent INT REFERENCES r (id))"
    )
    keys = t("region").select(F.col("r_regionkey").alias("id"))
    rows = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("parent"))
    for name, data in (("a.r", keys), ("b.r", keys), ("b.casc", rows), ("b.nulled", rows), ("b.own", rows)):
        engine.insert_rows(name, data)
    engine.sql("DELETE FROM a.r WHERE id < 2")
    refused = all(_refused(engine.sql, x) for x in ("DELETE FROM b.r WHERE id = 4", "INSERT INTO b.casc VALUES (1, 0)", "DROP TABLE a.r", "DROP DATABASE a"))
    return engine.query_text(f"SELECT 'cascade' AS rule, k, parent FROM b.casc UNION ALL SELECT 'null', k, parent FROM b.nulled UNION ALL SELECT 'refused', 1, {int(refused)}")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 300")
def index_clustered_range(engine, t):
    _table(engine, "l", t("lineitem", "l_orderkey", "l_linenumber", "l_quantity"))
    engine.sql("CREATE INDEX by_order ON l (l_orderkey)")
    engine.cluster("by_order")
    return engine.index_scan("by_order", 100, 300)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 7, -1.0")
def index_dropped(engine, t):
    _table(engine, "o", t("orders", "o_orderkey", "o_totalprice"))
    engine.sql("CREATE UNIQUE INDEX by_key ON o (o_orderkey)")
    if not _refused(engine.sql, "INSERT INTO o VALUES (7, -2.0)"):
        raise AssertionError("a unique index let a second key in")
    engine.sql("DROP INDEX by_key; INSERT INTO o VALUES (7, -1.0); CREATE INDEX again ON o (o_orderkey)")
    return engine.index_scan("again", 7, 7)


# -- joins, storage, streams, results


@query("SELECT n_name, r_name FROM nation FULL JOIN region ON n_nationkey = r_regionkey")
def engine_joins(engine, t):
    _table(engine, "n", t("nation", "n_nationkey", "n_name"))
    _table(engine, "r", t("region"))
    full = engine.full_join("n", "r", "n_nationkey", "r_regionkey")
    return full.select("n_name", "r_name")


@query("SELECT 'csv' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, min(o_orderpriority) AS low FROM orders UNION ALL SELECT 'json', count(*), CAST(sum(o_orderkey) AS BIGINT), min(o_orderpriority) FROM orders UNION ALL SELECT 'orc', count(*), CAST(sum(o_orderkey) AS BIGINT), min(o_orderpriority) FROM orders UNION ALL SELECT 'parquet', count(*), CAST(sum(o_orderkey) AS BIGINT), min(o_orderpriority) FROM orders")
def storage_round_trip(engine, t):
    rows, out = t("orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), None
    for kind in ("csv", "json", "orc", "parquet"):
        path = f"{engine.data_dir}/files/{kind}"
        write(rows, path, kind)
        back = engine.spark.read.schema(rows.schema).format(kind).load(path) if kind in ("csv", "json") else read(engine.spark, path, kind)
        one = back.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_orderpriority").alias("low")).select(F.lit(kind).alias("kind"), "n", "keys", "low")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_shipdate, l_quantity > 25 AS large FROM lineitem WHERE l_linenumber < 3")
def table_round_trip(engine, t):
    engine.sql("CREATE TABLE l (l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_returnflag VARCHAR(1), l_shipdate TIMESTAMP, large BOOL)")
    columns = ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    engine.insert_rows("l", t("lineitem", *columns).filter("l_linenumber < 3").withColumn("large", F.col("l_quantity") > 25))
    return Engine(engine.spark, engine.data_dir).table("l")  # another engine on the same folder


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest(engine, t):
    from relspark.streaming import stream_into

    columns = ("event_id", "user_id", "event_type", "value")
    engine.sql("CREATE TABLE e (event_id BIGINT PRIMARY KEY, user_id BIGINT, event_type TEXT, value DOUBLE)")
    rows = t("events", *columns)
    write(rows, f"{engine.data_dir}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = engine.spark.readStream.schema(rows.schema).parquet(f"{engine.data_dir}/in")
        stream_into(engine, "e", stream, f"{engine.data_dir}/state", availableNow=True).awaitTermination()
    return engine.table("e")


@query("SELECT r_regionkey, r_name FROM region")
def json_result(engine, t):
    _table(engine, "r", t("region"))
    got = json.loads(engine.sql("SELECT * FROM r").to_json())
    return engine.spark.createDataFrame([(row["r_regionkey"], row["r_name"]) for row in got["data"]], "r_regionkey int, r_name string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, steps=steps) for name, steps in _STEPS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
