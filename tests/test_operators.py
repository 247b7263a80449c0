import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.murmur import murmur3, murmur3_32
from tidemark.operators import dml, ring, skipping
from tidemark.operators.lww import latest, latest_values, overlay
from tidemark.plans.lexer import base_statement, condition_at, kind_of, statements
from tidemark.plans.parser import parse
from tidemark.sources.log import replay_text_log, to_text_log
from tidemark.spec import TableError
from tidemark.streaming.ingest import ingest, live_latest, resolved


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_murmur_vectors(spark):
    assert murmur3([b"hello", b"", b"hello, world", b"a" * 9]).tolist()[:2] == [613153351, 0]
    assert spark.createDataFrame([("hello",), (None,)], "k string").select(murmur3_32("k")).collect() == [(613153351,), (None,)]


def test_latest_does_not_depend_on_order_or_copies(spark):
    versions = [(k, ts, f"{k}{ts}") for k in "abc" for ts in range(5)]
    want = [(k, 4, f"{k}4") for k in "abc"]
    for seed in range(3):
        mixed = versions * 2
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame(mixed, "k string, ts long, v string")
        assert rows(latest(df, ["k"], ["ts"])) == want
        assert rows(latest_values(df, ["k"], ["ts"], ["ts", "v"])) == want


def test_tombstones_win_and_vanish(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 2, False)], "k string, ts long, d boolean")
    assert rows(latest(df, ["k"], ["ts"], "d")) == [("b", 2)]


def test_overlay(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "x"), (2, "y")], [(2, "z"), (3, "w")]))
    assert rows(overlay(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]


def test_conditional_fold(spark):
    writes = [("a", 1, None, "1"), ("a", 2, "0", "2"), ("a", 3, "1", "3"), ("b", 1, "x", "y")]
    df = spark.createDataFrame(writes, "k string, o int, e string, v string")
    assert rows(dml.fold_conditional(df, ["k"], "o", "e", "v")) == [("a", 2, "3"), ("b", 0, None)]


def _bits(key: bytes) -> set[int]:
    a, b = 5381, 0
    for c in key:
        a = (a * 33 + c) & (1 << 64) - 1
        b = (b * 31 + c) & (1 << 64) - 1
    return {a % 1024, b % 1024}


def test_bloom_equals_wrapping_hashes_and_has_no_false_negative(spark):
    keys = [f"k{i:04d}" for i in range(40)] + ["é", "日本語", "a🙂b", "naïve" * 3, ""]
    df = spark.createDataFrame([(0, k) for k in keys], "s int, k string")
    bits = skipping.bloom(df, "s", F.col("k"))
    assert set(bits.first()["bits"]) == set().union(*(_bits(k.encode()) for k in keys))
    assert df.join(bits, "s").where(~skipping.may_contain(F.col("k"))).count() == 0


def test_segments_by_bitmaps(spark):
    df = spark.createDataFrame([(i // 3, f"key {i}") for i in range(600)], "s long, k string")
    blooms = skipping.bloom(df, "s", F.col("k"))
    probes = spark.createDataFrame([(f"key {i}",) for i in range(0, 900, 7)], "k string")
    sets = {r["s"]: set(r["bits"]) for r in blooms.collect()}
    want = [(p["k"], n) for p in probes.collect() if (n := sum(_bits(p["k"].encode()) <= b for b in sets.values()))]
    assert rows(skipping.segments_with(probes, blooms, "s", "k")) == sorted(want, key=str)


def test_compacted_lookup_reads_few_rows(spark, tmp_path):
    from pyspark.sql import types as T

    from tidemark.sources.log import Log
    from tidemark.spec import TableSpec

    spec = TableSpec("t", ("k",), (), T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())]))
    log = Log(spark, f"file://{tmp_path}")
    log.append(spec, 1, spark.range(20_000).selectExpr("id * 7 % 20000 AS k", "'x' AS v", "1L AS __ts", "1L AS __seq", "false AS __deleted").distinct())
    log.compact(spec, 1, 10)
    df = log.mutations(spec, 2).where("k = 4242")
    assert df.count() == 1 and df.collect()[0]["k"] == 4242
    leaf = df._jdf.queryExecution().executedPlan()
    while leaf.children().size():
        leaf = leaf.children().head()
    read = leaf.metrics().get("numOutputRows").get().value()
    assert 0 < read <= 2_100  # one of ten files


def test_zone_maps(spark):
    z = skipping.zone_map(spark.createDataFrame([(0, 3), (0, 9), (1, 20)], "s int, k int"), "s", "k")
    assert rows(z.where(skipping.in_zone(F.lit(5))).select("s")) == [(0,)]
    free = spark.createDataFrame([(7, None, None)], "s int, min_key int, max_key int")
    assert free.where(skipping.in_zone(F.lit(5))).count() == 1


def test_sparse_index_and_seek(spark):
    df = spark.createDataFrame([(0, f"k{i:02d}") for i in range(40)], "s int, k string")
    index = skipping.sparse_index(df, "s", "k", F.lit(10).cast("long"))
    assert rows(index) == [(0, "k00", 0), (0, "k16", 160), (0, "k32", 320)]
    probes = spark.createDataFrame([(0, "k17"), (0, "a")], "s int, k string")
    assert rows(skipping.seek(probes, index, "s", "k")) == [(0, "a", 0), (0, "k17", 160)]


def test_ring(spark):
    nodes = ["a", "b", "c", "d"]
    keys = spark.createDataFrame([(f"key{i}",) for i in range(200)], "k string")
    for r in ring.replicas(keys, F.col("k"), nodes, 3).collect():
        assert len(set(r["replicas"])) == 3 and r["replicas"] == ring.replicas_of(r["k"], nodes, 3)
    assert len(ring.replicas_of("x", nodes, 9)) == 4


def test_required(spark):
    df = spark.createDataFrame([("ONE", 3), ("QUORUM", 3), ("QUORUM", 4), ("ALL", 0)], "l string, n int")
    assert [r[0] for r in df.select(ring.required(F.col("l"), F.col("n"))).collect()] == [1, 2, 3, 1]


def test_text_log_round_trip_and_bad_line(spark):
    df = spark.createDataFrame([("t:1", "{\"a\": \"é\"}"), ("t:2", "")], "key string, payload string")
    assert rows(replay_text_log(to_text_log(df, "key", "payload"))) == rows(df)
    with pytest.raises(Exception):
        replay_text_log(spark.createDataFrame([("k\t***",)], "value string")).collect()


@pytest.mark.parametrize(
    "sql, has",
    [
        ("INSERT INTO t VALUES ('what if it rains')", False),
        ("INSERT INTO t VALUES ('it''s if, not when')", False),
        ("UPDATE t SET v = '1' -- IF val='1'\n WHERE id = '1'", False),
        ("UPDATE notif SET v = '1' WHERE id = '1'", False),
        ("UPDATE t SET v = 'if' WHERE id = '1' IF v = 'if'", True),
        ("INSERT INTO t VALUES ('1') if not exists", True),
        ("SELECT IF(a, b, c) FROM t", False),
    ],
)
def test_condition_clause(sql, has):
    assert (condition_at(sql) is not None) is has
    assert ("IF" in base_statement(sql).upper().split()) is False or not has


def test_statements_and_kinds():
    assert statements("SELECT ';' ; -- x;\n INSERT INTO t VALUES ('a;b');") == ["SELECT ';'", "-- x;\n INSERT INTO t VALUES ('a;b')"]
    assert kind_of("SELECT COUNT(*) FROM t")["count"] and kind_of("DROP TABLE t")["broadcast"] and kind_of("UPDATE t SET a = 1 WHERE k = 1 IF a = 2")["conditional"]


def test_keys_of_create():
    assert parse("CREATE TABLE a.B (x INT, y TEXT, z VARCHAR(9), PRIMARY KEY(y, x))").spec.keys == ("y", "x")
    assert parse("CREATE TABLE b (x INT PRIMARY KEY, y TEXT)").spec.partition == ("x",)
    with pytest.raises(TableError):
        parse("UPDATE t SET a = 1 WHERE k = 1 AND k = 2")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab'; -\n", max_size=20))
def test_any_text_survives_quoting(text):
    sql = "INSERT INTO t VALUES ('" + text.replace("'", "''") + "')"
    assert len(statements(sql)) == 1 and parse(sql).rows == [[text]]


def test_stream(spark, tmp_path):
    source, log = f"file://{tmp_path}/in", f"file://{tmp_path}/log"
    schema = "k string, ts long, v string"
    for batch in ([("a", 2, "new")], [("a", 1, "late"), ("b", 5, "x")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(schema).parquet(source), log, f"file://{tmp_path}/c").awaitTermination()
    assert rows(resolved(spark.read.parquet(log), ["k"], ["ts"]).select("k", "ts", "v")) == [("a", 2, "new"), ("b", 5, "x")]
    live = live_latest(spark.readStream.schema(schema).parquet(source), ["k"], "ts", ["v"])
    q = live.writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("a", 2, "new") in rows(spark.table("live"))
