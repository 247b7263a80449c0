import pytest

from tidemark.engine import Engine
from tidemark.fmt import result_text, table_text
from tidemark.spec import PartitionKeyError, TableError

KV = "CREATE TABLE kv (id TEXT, val TEXT, PRIMARY KEY(id))"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_insert_select_overwrite(engine):
    engine.sql(f"{KV}; INSERT INTO kv VALUES ('a', '1'), ('b', '2')")
    engine.sql("INSERT INTO kv VALUES ('a', '3')")
    assert rows(engine.sql("SELECT * FROM kv")) == [("a", "3"), ("b", "2")]
    assert engine.sql("SELECT COUNT(*) AS count FROM kv WHERE id = 'a'").first()[0] == 1


def test_late_write_loses(engine):
    engine.sql(KV)
    engine.sql("INSERT INTO kv VALUES ('a', 'new')", ts=200)
    engine.sql("INSERT INTO kv VALUES ('a', 'old')", ts=100)
    assert rows(engine.sql("SELECT val FROM kv")) == [("new",)]


def test_same_time_takes_the_later_statement(engine):
    engine.sql(KV)
    for v in "xyz":
        engine.sql(f"INSERT INTO kv VALUES ('a', '{v}')", ts=5)
    assert rows(engine.sql("SELECT val FROM kv")) == [("z",)]


def test_update_is_an_upsert_and_keeps_other_columns(engine):
    engine.sql("CREATE TABLE t (k TEXT, c INT, a TEXT, b TEXT, PRIMARY KEY(k, c)); INSERT INTO t VALUES ('x', 1, 'a', 'b')")
    engine.sql("UPDATE t SET b = 'B' WHERE k = 'x' AND c = 1; UPDATE t SET a = 'n' WHERE k = 'y' AND c = -2")
    assert rows(engine.sql("SELECT * FROM t")) == [("x", 1, "a", "B"), ("y", -2, "n", None)]


def test_delete_and_reinsert(engine):
    engine.sql(f"{KV}; INSERT INTO kv VALUES ('a', '1'); DELETE FROM kv WHERE id = 'a'")
    assert rows(engine.sql("SELECT * FROM kv")) == []
    told = engine.sql("INSERT INTO kv VALUES ('a', '2') IF NOT EXISTS")
    assert rows(told) == [("true",)] and rows(engine.sql("SELECT * FROM kv")) == [("a", "2")]


def test_compare_and_set(engine):
    engine.sql(f"{KV}; INSERT INTO kv VALUES ('a', '1')")
    assert rows(engine.sql("INSERT INTO kv VALUES ('a', '9') IF NOT EXISTS")) == [("false",)]
    assert rows(engine.sql("UPDATE kv SET val = '2' WHERE id = 'a' IF val = '1'")) == [("true",)]
    failed = engine.sql("UPDATE kv SET val = '3' WHERE id = 'a' IF val = '1'")
    assert failed.columns == ["[applied]", "val"] and rows(failed) == [("false", "2")]
    assert rows(engine.sql("UPDATE kv SET val = '3' WHERE id = 'zz' IF val = '1'"))[0][0] == "false"


@pytest.mark.parametrize("bad", ["INSERT INTO kv VALUES ('a', '1') IF val = '1'", "UPDATE kv SET val = '1' WHERE id = 'a' IF NOT EXISTS", "UPDATE kv SET val = '1' WHERE id = 'a' IF nonsense", "ALTER TABLE kv"])
def test_refused(engine, bad):
    engine.sql(KV)
    with pytest.raises(TableError):
        engine.sql(bad)


def test_ddl(engine):
    engine.sql(KV)
    with pytest.raises(TableError):
        engine.sql(KV)
    engine.sql("CREATE TABLE IF NOT EXISTS kv (id TEXT PRIMARY KEY)")
    engine.sql("CREATE TABLE ks.Other (id INT PRIMARY KEY, v INT)")
    assert rows(engine.sql("SHOW TABLES")) == [("kv",), ("other",)]
    engine.sql("INSERT INTO kv VALUES ('a', '1'); TRUNCATE kv")
    assert rows(engine.sql("SELECT * FROM kv")) == []
    engine.sql("DROP TABLE kv")
    with pytest.raises(Exception):
        engine.sql("INSERT INTO kv VALUES ('a', '1')")
    with pytest.raises(TableError):
        engine.sql("CREATE TABLE nokey (a TEXT)")


def test_dropped_table_comes_back_empty(engine):
    engine.sql(f"{KV}; INSERT INTO kv VALUES ('a', '1'); DROP TABLE kv; {KV}")
    assert rows(engine.sql("SELECT * FROM kv")) == []


def test_strict_gate(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/strict", strict=True)
    e.sql("CREATE TABLE orders (customer_id TEXT, order_id TEXT, d TEXT, PRIMARY KEY(customer_id, order_id))")
    e.sql("INSERT INTO orders VALUES ('nike', 'abc', '1'), ('nike', 'def', '2')")
    assert len(rows(e.sql("SELECT * FROM orders WHERE customer_id = 'nike'"))) == 2
    assert e.sql("SELECT COUNT(*) FROM orders").first()[0] == 2
    for bad in ("SELECT * FROM orders WHERE order_id = 'abc'", "SELECT * FROM orders", "UPDATE orders SET d = '1' WHERE customer_id = 'nike'", "INSERT INTO orders (customer_id, d) VALUES ('a', 'b')"):
        with pytest.raises(PartitionKeyError):
            e.sql(bad)


def test_restart_and_compaction(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    e = Engine(spark, root)
    e.sql(f"{KV}; INSERT INTO kv VALUES ('a', '1'), ('b', '2'); DELETE FROM kv WHERE id = 'b'; INSERT INTO kv VALUES ('a', '3')")
    e.compact("kv")
    again = Engine(spark, root)
    assert rows(again.sql("SELECT * FROM kv")) == [("a", "3")]
    again.sql("INSERT INTO kv VALUES ('c', '4')")
    assert rows(Engine(spark, root).sql("SELECT * FROM kv")) == [("a", "3"), ("c", "4")]


def test_insert_select_and_analytics(engine):
    engine.sql("CREATE TABLE src (id INT PRIMARY KEY, g TEXT, v INT); INSERT INTO src VALUES (1, 'a', 5), (2, 'a', 7), (3, 'b', 1)")
    engine.sql("CREATE TABLE sums (g TEXT PRIMARY KEY, total INT)")
    engine.sql("INSERT INTO sums SELECT g, SUM(v) FROM src GROUP BY g")
    assert rows(engine.sql("SELECT * FROM sums")) == [("a", 12), ("b", 1)]
    assert rows(engine.sql("SELECT s.id FROM src s JOIN sums t ON s.g = t.g WHERE t.total > 5")) == [(1,), (2,)]


def test_insert_select_of_equal_keys(engine):
    engine.sql("CREATE TABLE src (id INT PRIMARY KEY, g TEXT, v INT); INSERT INTO src VALUES (1, 'a', 5), (2, 'a', 7), (3, 'b', 1), (4, 'a', 7)")
    engine.sql("CREATE TABLE t (g TEXT PRIMARY KEY, v INT)")
    told = engine.sql("INSERT INTO t SELECT g, v FROM src")
    assert told.first()["count"] == 2 and rows(engine.sql("SELECT * FROM t")) == [("a", 7), ("b", 1)]


def test_prefix_delete_and_functions(engine):
    import pyarrow as pa
    import pyarrow.compute as pc

    engine.sql("CREATE TABLE t (k TEXT, c INT, v TEXT, PRIMARY KEY(k, c)); INSERT INTO t VALUES ('x', 1, 'a'), ('x', 2, 'b'), ('y', 1, 'c')")
    assert engine.delete_prefix("t", k="x") == 2 and rows(engine.sql("SELECT * FROM t")) == [("y", 1, "c")]
    with pytest.raises(PartitionKeyError):
        engine.delete_prefix("t", c=1)

    def shout(values: pa.Array) -> pa.Array:
        return pc.utf8_upper(values)

    engine.register("shout", shout, "string")
    assert rows(engine.sql("SELECT shout(v) FROM t")) == [("C",)]


def test_quotes_and_text(engine):
    engine.sql(KV)
    engine.sql("INSERT INTO kv VALUES ('a', 'it''s as if; by magic -- no')")
    assert engine.sql("SELECT val FROM kv").first()[0] == "it's as if; by magic -- no"


def test_text_tables():
    # Fixed value: the layout that clients expect.
    assert table_text([{"a": 1}, {"a": 2}]) == "  a\n0 1\n1 2\n(2 rows)\n"


def test_result_text(engine):
    assert result_text(engine.sql(KV)) == "CREATE TABLE 1 table\n"
    assert result_text(engine.sql("INSERT INTO kv VALUES ('a', '1')")) == "INSERT 1 row\n"
    assert engine.partition_keys("SELECT * FROM kv WHERE id = 'a'") == ["id"]


def test_key_filters_reach_the_scan(engine):
    engine.sql("CREATE TABLE t (k INT, c INT, v TEXT, PRIMARY KEY(k, c)); INSERT INTO t VALUES (1, 1, 'x')")
    plan = engine.sql("SELECT * FROM t WHERE k = 1 AND v = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in plan and "EqualTo(v" not in plan


def test_buffer(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    e = Engine(spark, root, buffer=4)
    e.sql(f"{KV}; INSERT INTO kv VALUES ('a', '1'), ('b', '2'); UPDATE kv SET val = '3' WHERE id = 'a' IF val = '1'")
    assert len(e.pending["kv"]) == 3 and rows(e.sql("SELECT * FROM kv")) == [("a", "3"), ("b", "2")]
    assert rows(Engine(spark, root).sql("SELECT * FROM kv")) == []  # not yet durable
    e.sql("DELETE FROM kv WHERE id = 'b'")
    assert "kv" not in e.pending and rows(Engine(spark, root).sql("SELECT * FROM kv")) == [("a", "3")]
    e.sql("INSERT INTO kv VALUES ('c', '4'); TRUNCATE kv")
    e.flush()
    assert rows(e.sql("SELECT * FROM kv")) == []
