"""The engine's operators as queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.murmur import murmur3_32
from .operators import dml, replica, ring, skipping
from .operators.lww import latest, latest_values, overlay
from .plans.parser import parse
from .sources.log import decode_row, encode_row, replay_text_log, split_version, to_text_log, version
from .sources.shared import shared_folder, written
from .streaming.ingest import ingest, resolved, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NODES = ["n0", "n1", "n2", "n3", "n4"]
#: lineitem as a table of versions: keys, and a total order of the versions of a key.
KEYS, ORDER = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]


class Tables:
    """The tables of a folder: t(name) reads one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function (Tables) -> DataFrame under its name, and its SQL."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _lineitem(t) -> DataFrame:
    return latest(t("lineitem"), KEYS, ORDER)


_LATEST = "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1"

# --- reads by key ---------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_custkey = 7 AND o_orderkey > 0")
def point_get(t):
    return t("orders").where("o_custkey = 7 AND o_orderkey > 0").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (1, 5, 9, 42)")
def point_get_in(t):
    return t("customer").where(F.col("c_custkey").isin(1, 5, 9, 42)).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT k.pos, c.c_custkey, c.c_name FROM (VALUES (0, 42), (1, 5), (2, 42), (3, 1)) AS k(pos, key) JOIN customer c ON c.c_custkey = k.key")
def key_order_in(t):
    keys = t.spark.createDataFrame([(0, 42), (1, 5), (2, 42), (3, 1)], "pos int, key long")
    return t("customer").join(F.broadcast(keys), F.col("c_custkey") == F.col("key")).select("pos", "c_custkey", "c_name").orderBy("pos")


@query("SELECT a.key AS l_orderkey, b.num AS l_linenumber, l.l_quantity FROM (VALUES (1), (2), (3)) AS a(key), (VALUES (1), (2)) AS b(num), (" + _LATEST + ") l WHERE l.l_orderkey = a.key AND l.l_linenumber = b.num")
def key_cartesian(t):
    return _lineitem(t).where(F.col("l_orderkey").isin(1, 2, 3) & F.col("l_linenumber").isin(1, 2)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT user_id, ts, event_type, value FROM events WHERE user_id = 3")
def prefix_scan(t):
    return t("events").where("user_id = 3").select("user_id", "ts", "event_type", "value").orderBy("user_id", "ts")


@query("SELECT user_id, ts, event_type, value FROM events WHERE user_id IN (3, 4, 5) AND event_type = 'click'")
def prefix_residual(t):
    return t("events").where(F.col("user_id").isin(3, 4, 5) & (F.col("event_type") == "click")).select("user_id", "ts", "event_type", "value")


@query("SELECT p_partkey, p_brand FROM part")
def project_columns(t):
    return t("part").select("p_partkey", "p_brand")


@query("SELECT * FROM nation")
def project_star(t):
    return t("nation")


@query("""SELECT c_custkey, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN coalesce(CAST(try_cast(raw AS BIGINT) AS VARCHAR), raw) ELSE raw END AS raw
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '00' || c_custkey WHEN 1 THEN '-' || c_custkey WHEN 2 THEN 'x' || c_custkey ELSE '99999999999999999999' END AS raw FROM customer)""")
def cast_int(t):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("00"), k)).when(k % 4 == 1, F.concat(F.lit("-"), k)).when(k % 4 == 2, F.concat(F.lit("x"), k)).otherwise("99999999999999999999")
    cast = F.expr("CASE WHEN raw RLIKE '^[+-]?[0-9]+$' THEN coalesce(CAST(try_cast(raw AS BIGINT) AS STRING), raw) ELSE raw END")
    return t("customer").select("c_custkey", raw.alias("raw")).select("c_custkey", cast.alias("raw"))


# --- counts ---------------------------------------------------------------------------------


@query('SELECT count(*) AS "count" FROM lineitem')
def count_all(t):
    return t("lineitem").agg(F.count(F.lit(1)).alias("count"))


@query(f'SELECT count(*) AS "count" FROM ({_LATEST}) WHERE l_orderkey = 1 AND l_linenumber = 1')
def count_key(t):
    return _lineitem(t).where("l_orderkey = 1 AND l_linenumber = 1").agg(F.count(F.lit(1)).alias("count"))


@query('SELECT count(*) AS "count" FROM orders WHERE o_custkey = 7')
def count_partition(t):
    return t("orders").where("o_custkey = 7").agg(F.count(F.lit(1)).alias("count"))


@query('SELECT count(*) AS "count" FROM orders WHERE o_custkey IN (1, 7, 13)')
def count_in(t):
    return t("orders").where(F.col("o_custkey").isin(1, 7, 13)).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem")
def count_distinct(t):
    return t("lineitem").agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_partkey").alias("n_parts"))


# --- predicates -----------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE (o_custkey = 7 OR o_totalprice > 400000) AND NOT o_orderstatus = 'F'")
def predicate_or(t):
    return t("orders").where("(o_custkey = 7 OR o_totalprice > 400000) AND NOT o_orderstatus = 'F'").select("o_orderkey")


@query("SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 1) AND n_name LIKE '%A%'")
def predicate_not_in_like(t):
    return t("nation").where("n_regionkey NOT IN (0, 1) AND n_name LIKE '%A%'").select("n_name")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice >= 1000 AND p_retailprice <> 1001")
def predicate_range(t):
    return t("part").where("p_size BETWEEN 10 AND 20 AND p_retailprice >= 1000 AND p_retailprice <> 1001").select("p_partkey", "p_retailprice")


@query("SELECT c_custkey, n_name IS NULL AS no_nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON c_nationkey = n_nationkey WHERE n_name IS NULL")
def predicate_is_null(t):
    n = F.broadcast(t("nation").where("n_regionkey = 1"))
    return t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").where("n_name IS NULL").select("c_custkey", F.col("n_name").isNull().alias("no_nation"))


# --- versions -------------------------------------------------------------------------------


@query(_LATEST)
def lww_latest(t):
    return _lineitem(t)


@query("SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def lww_max_by(t):
    return latest_values(t("events"), ["user_id"], ["ts"], ["ts", "value"])


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders),
n AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 10000000, 0, 'N' FROM orders WHERE o_orderkey % 10 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)""")
def lww_overlay(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    added = o.where("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"), F.lit("N").alias("o_orderstatus"))
    return overlay(o, changed.union(added), ["o_orderkey"])


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def tombstone_filter(t):
    rows = t("events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("deleted"))
    return latest(rows, ["user_id"], ["ts", "event_id"], "deleted")


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def late_write_loses(t):
    """Versions decide, not the order of arrival: no order is asked for, and none would matter."""
    return latest(t("events").select("user_id", "event_id", "ts"), ["user_id"], ["ts"]).select("user_id", "event_id")


@query("SELECT conv_id, turn, role, text FROM conversations")
def namespace_scan(t):
    return t("conversations").select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")


@query(f"SELECT count(*) AS n_rows, sum(l_quantity) AS quantity FROM ({_LATEST})")
def lww_totals(t):
    return _lineitem(t).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_versions FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def superseded_versions(t):
    return t("lineitem").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_versions")).where("n_versions > 1")


# --- documented SQL -------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def order_by(t):
    return t("supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy(F.col("s_acctbal").desc(), "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def limit_offset(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(20).limit(10)


@query('SELECT o_orderstatus, count(*) AS "count" FROM orders GROUP BY o_orderstatus')
def group_count(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT l_returnflag, l_linestatus, min(l_quantity) AS min_q, max(l_quantity) AS max_q, sum(l_quantity) AS sum_q, round(avg(l_discount), 6) AS avg_d FROM lineitem GROUP BY 1, 2")
def group_min_max_sum(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"), F.sum("l_quantity").alias("sum_q"), F.round(F.avg("l_discount"), 6).alias("avg_d"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_values(t):
    return t("part").select("p_brand", "p_size").distinct()


@query('SELECT user_id, count(*) AS "count" FROM events GROUP BY user_id ORDER BY "count" DESC, user_id LIMIT 10')
def group_order_limit(t):
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "user_id").limit(10)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
def group_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def group_rollup(t):
    rows = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n, round(mean, 4) AS mean, p50, p95, p99, p999, worst FROM (
SELECT count(*) AS n, avg(value) AS mean, max(value) AS worst, list_sort(list(value)) AS v,
v[CAST(round(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS p50, v[CAST(round(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95, v[CAST(round(0.99 * (count(*) - 1)) AS BIGINT) + 1] AS p99, v[CAST(round(0.999 * (count(*) - 1)) AS BIGINT) + 1] AS p999 FROM events)""")
def latency_stats(t):
    """Exact order statistics at round(p * (n - 1)): percentile over counted values, not a sorted list."""
    v = t("events").select("value")
    n = v.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("worst"))
    counts = v.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    # The rank of the last row of each value: a range exchange and offsets of its partitions.
    ranked = _running(counts, "value", "c", "upto")
    asked = n.select("*", F.explode(F.expr("map('p50', 0.5D, 'p95', 0.95D, 'p99', 0.99D, 'p999', 0.999D)")).alias("name", "p")).withColumn("at", F.round(F.col("p") * (F.col("n") - 1)).cast("long"))
    hit = ranked.join(F.broadcast(asked), (F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at")))
    return hit.groupBy("n", "mean", "worst").pivot("name", ["p50", "p95", "p99", "p999"]).agg(F.first("value")).select("n", "mean", "p50", "p95", "p99", "p999", "worst")


def _running(df: DataFrame, by: str, value: str, name: str, *ties: str) -> DataFrame:
    """Adds the running sum of value in the order of by (and ties), without one task for all rows.

    Range partitions, a window inside each, and the totals of those before, of which there are as
    many as partitions. The dealt rows are written once, so both uses see the same partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, by).withColumn("__p", F.spark_partition_id()), "ranged")
    totals = rows.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__in", inside).join(F.broadcast(before), "__p").withColumn(name, F.col("__in") + F.col("__before")).drop("__p", "__in", "__before")


# --- writes as transforms -------------------------------------------------------------------


@query("""SELECT * FROM (SELECT n_nationkey AS id, n_name AS val FROM nation WHERE n_nationkey <> 3 UNION ALL VALUES (3, 'new'), (100, 'x'))""")
def insert_multi(t):
    spark = t.spark
    old = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("val"))
    return overlay(old, spark.createDataFrame([(3, "new"), (100, "x")], "id int, val string"), ["id"])


@query("""SELECT coalesce(c.c_custkey, u.k) AS c_custkey, c_name, CASE WHEN u.k IS NOT NULL THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer c
FULL JOIN (SELECT c_custkey * 2 AS k FROM customer) u ON c.c_custkey = u.k""")
def update_upsert(t):
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = c.select((F.col("c_custkey") * 2).alias("c_custkey"))
    return overlay(c, dml.merged(changes, c, ["c_custkey"], {"c_mktsegment": F.lit("UPDATED")}, ["c_custkey", "c_name", "c_mktsegment"]), ["c_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def delete_key(t):
    o = t("orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("ts"), F.lit(False).alias("deleted"))
    gone = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(None).cast("double").alias("o_totalprice"), F.lit(1).alias("ts"), F.lit(True).alias("deleted"))
    return latest(o.unionByName(gone), ["o_orderkey"], ["ts"], "deleted").drop("ts")


@query("SELECT s_suppkey + 500 AS s_suppkey, s_name FROM supplier WHERE s_suppkey + 500 NOT IN (SELECT s_suppkey FROM supplier)")
def insert_if_not_exists(t):
    s = t("supplier")
    return dml.absent(s.select((F.col("s_suppkey") + 500).alias("s_suppkey"), "s_name"), s, ["s_suppkey"])


@query("""SELECT o_orderkey, coalesce(o_orderstatus = 'O', false) AS applied, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS after FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey + 20000000, false, NULL FROM orders WHERE o_orderkey % 100 = 0""")
def update_if_equals(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    changes = o.where("o_orderkey % 2 = 0").select("o_orderkey").union(o.where("o_orderkey % 100 = 0").select(F.col("o_orderkey") + 20000000))
    changes = changes.withColumn("want", F.lit("O")).withColumn("set", F.lit("X"))
    return dml.compared(changes, o, ["o_orderkey"], "o_orderstatus", "want", "set").select("o_orderkey", "applied", "after")


@query("""WITH RECURSIVE w AS (SELECT user_id, event_type AS v, lag(event_type, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, CAST(NULL AS VARCHAR) AS final, CAST(0 AS BIGINT) AS n_applied, CAST(0 AS BIGINT) AS r FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT f.user_id, CASE WHEN f.final IS NOT DISTINCT FROM w.e THEN w.v ELSE f.final END, f.n_applied + CAST(f.final IS NOT DISTINCT FROM w.e AS BIGINT), f.r + 1 FROM f JOIN w ON w.user_id = f.user_id AND w.r = f.r + 1)
SELECT user_id, n_applied, final FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1""")
def conditional_fold(t):
    w = t("events").select("user_id", "event_id", F.col("event_type").alias("v"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("e"))
    return dml.fold_conditional(w, ["user_id"], "event_id", "e", "v")


def _engine(t, strict: bool = False, buffer: int = 0):
    """An engine on a folder of its own, below the shared one if there is one."""
    from .engine import Engine

    spark = t.spark
    return Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}", strict, buffer=buffer)


@query("SELECT 0 AS n_before_insert, 'b' AS id WHERE true")
def truncate_table(t):
    e = _engine(t)
    e.sql("CREATE TABLE kv (id TEXT, val TEXT, PRIMARY KEY(id)); INSERT INTO kv VALUES ('a', '1'); TRUNCATE TABLE kv")
    n = e.sql("SELECT COUNT(*) AS n FROM kv").first()["n"]
    e.sql("INSERT INTO kv VALUES ('b', '2')")
    return e.sql("SELECT id FROM kv").select(F.lit(int(n)).alias("n_before_insert"), "id")


@query("""SELECT * FROM (VALUES ('kv'), ('users')) AS x("tableName")""")
def show_tables(t):
    e = _engine(t)
    e.sql("CREATE TABLE users (user_id TEXT, ts TEXT, value TEXT, PRIMARY KEY(user_id, ts)); CREATE TABLE ks.KV (id TEXT PRIMARY KEY, val TEXT); CREATE TABLE gone (id INT PRIMARY KEY); DROP TABLE gone")
    return e.sql("SHOW TABLES")


@query("""SELECT * FROM (VALUES ('a', '3', 1), ('c', NULL, 7)) AS x(id, val, n)""")
def engine_dml(t):
    e = _engine(t)
    e.sql("CREATE TABLE kv (id TEXT, val TEXT, n INT, PRIMARY KEY(id)); INSERT INTO kv VALUES ('a', '1', 1), ('b', '2', 2)")
    e.sql("UPDATE kv SET val = '3' WHERE id = 'a' IF val = '1'; UPDATE kv SET val = '9' WHERE id = 'a' IF val = '1'; UPDATE kv SET n = 7 WHERE id = 'c'")
    e.sql("INSERT INTO kv (id, val) VALUES ('b', 'x') IF NOT EXISTS; DELETE FROM kv WHERE id = 'b'")
    return e.sql("SELECT * FROM kv")


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key, CAST(l_orderkey AS VARCHAR) AS part_1 FROM lineitem")
def key_encode_decode(t):
    rows = t("lineitem").select(*KEYS, F.concat_ws("|", *KEYS).alias("key"))
    return rows.withColumn("part_1", F.split("key", r"\|")[0])


@query("SELECT p_partkey, p_name, p_size FROM part")
def row_json_codec(t):
    rows = t("part").select(encode_row(["p_partkey", "p_name", "p_size"]).alias("row"))
    return rows.select(decode_row("row", "p_partkey long, p_name string, p_size int").alias("r")).select("r.*")


@query("SELECT 'conv:' || conv_id || '|' || turn AS key, role || ': ' || text AS payload FROM conversations")
def wal_replay(t):
    rows = t("conversations").select(F.concat(F.lit("conv:"), F.col("conv_id"), F.lit("|"), F.col("turn")).alias("key"), F.concat("role", F.lit(": "), "text").alias("payload"))
    return replay_text_log(to_text_log(rows, "key", "payload"))


@query("SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS version_ts, event_type AS payload FROM events")
def version_codec(t):
    rows = t("events").select("event_id", version(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_type")).alias("cell"))
    return rows.select("event_id", split_version(F.col("cell")).alias("v")).select("event_id", F.col("v.ts").alias("version_ts"), F.col("v.payload").alias("payload"))


@query("SELECT 'a' AS id, '2' AS val, CAST(1 AS BIGINT) AS n_buffered UNION ALL SELECT 'c', '3', 1")
def buffered_writes(t):
    """A memory buffer over segments: reads see both, a flush moves rows without changing answers."""
    e = _engine(t, buffer=3)
    e.sql("CREATE TABLE kv (id TEXT, val TEXT, PRIMARY KEY(id)); INSERT INTO kv VALUES ('a', '1'), ('b', '1'); INSERT INTO kv VALUES ('a', '2'); DELETE FROM kv WHERE id = 'b'")
    n = len(e.pending.get("kv", []))
    e.flush()
    e.sql("INSERT INTO kv VALUES ('c', '3')")
    return e.sql("SELECT * FROM kv").withColumn("n_buffered", F.lit(n).cast("long"))


# --- data skipping --------------------------------------------------------------------------


@query("SELECT year(o_orderdate) AS segment, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, count(*) AS n_keys FROM orders GROUP BY 1")
def zone_map_build(t):
    return skipping.zone_map(t("orders").withColumn("segment", F.year("o_orderdate").cast("long")), "segment", "o_orderkey")


_ZONES = "SELECT o_orderkey // 500 AS segment, min(o_custkey) AS min_key, max(o_custkey) AS max_key FROM orders GROUP BY 1"


@query(f"SELECT p.key, count(*) AS n_segments FROM (SELECT c_custkey AS key FROM customer WHERE c_custkey % 50 = 0) p JOIN ({_ZONES}) z ON p.key BETWEEN z.min_key AND z.max_key GROUP BY p.key")
def zone_map_prune(t):
    """How many zones of the whole table hold each key: a sweep over zone ends and keys, no
    key-by-zone join."""
    zones = skipping.zone_map(t("orders").withColumn("segment", F.floor(F.col("o_orderkey") / 500)), "segment", "o_custkey")
    probes = t("customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("key"))
    marks = lambda df, key, kind, step: df.select(F.col(key).alias("key"), F.lit(kind).alias("kind"), F.lit(step).cast("long").alias("step"))
    swept = marks(zones, "min_key", 0, 1).union(marks(probes, "key", 1, 0)).union(marks(zones, "max_key", 2, -1))
    return _running(swept, "key", "step", "n_segments", "kind").where("kind = 1 AND n_segments > 0").select("key", "n_segments")


_H = "CAST(list_reduce(list_prepend(CAST({s} AS BIGINT), list_transform(range(strlen(key)), lambda i: ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::BIGINT)), lambda h, b: (h * {m} + b) % 1024) AS BIGINT)"
_KEYED = "SELECT o_orderkey // 150 AS segment, CAST(o_orderkey AS VARCHAR) AS key FROM orders"
_BITS = f"SELECT DISTINCT segment, bit FROM (SELECT segment, {_H.format(s=261, m=33)} AS bit FROM ({_KEYED}) UNION ALL SELECT segment, {_H.format(s=0, m=31)} FROM ({_KEYED}))"


def _blooms(t):
    rows = t("orders").select(F.floor(F.col("o_orderkey") / 150).alias("segment"), F.col("o_orderkey").cast("string").alias("key"))
    return skipping.bloom(rows, "segment", F.col("key"))


@query(f"SELECT segment, count(*) AS n_bits, CAST(sum(bit) AS BIGINT) AS bit_sum, min(bit) AS low, max(bit) AS high FROM ({_BITS}) GROUP BY segment")
def bloom_build(t):
    b = F.col("bits")
    return _blooms(t).select("segment", F.size(b).cast("long").alias("n_bits"), F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x).alias("bit_sum"), F.array_min(b).alias("low"), F.array_max(b).alias("high"))


@query(f"""SELECT p.key, count(*) AS n_segments FROM (SELECT key, {_H.format(s=261, m=33)} AS a, {_H.format(s=0, m=31)} AS b FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 50 = 0)) p
JOIN ({_BITS}) x ON x.bit = p.a JOIN ({_BITS}) y ON y.bit = p.b AND y.segment = x.segment GROUP BY p.key""")
def bloom_probe(t):
    """Every key divisible by 50 against the filters of all segments, by bitmaps."""
    return skipping.segments_with(t("orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").cast("string").alias("key")), _blooms(t), "segment", "key")


_LENGTH = "CAST(length(c_name) + length(c_mktsegment) + 2 AS BIGINT)"
_INDEX = f"""SELECT segment, c_custkey AS index_key, CAST("offset" AS BIGINT) AS "offset" FROM (SELECT c_nationkey AS segment, c_custkey, row_number() OVER w AS nth, sum({_LENGTH}) OVER w - {_LENGTH} AS "offset" FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)) WHERE (nth - 1) % 16 = 0"""


def _index(t):
    length = (F.length("c_name") + F.length("c_mktsegment") + 2).cast("long")
    return skipping.sparse_index(t("customer").withColumn("segment", F.col("c_nationkey")), "segment", "c_custkey", length)


@query(_INDEX)
def sparse_index(t):
    return _index(t)


@query(f"""SELECT p.segment, p.key, coalesce(max(i."offset"), 0) AS "offset" FROM (SELECT c_nationkey AS segment, c_custkey - 1 AS key FROM customer) p LEFT JOIN ({_INDEX}) i ON i.segment = p.segment AND i.index_key <= p.key GROUP BY 1, 2""")
def sparse_seek(t):
    """Keys beside those of the table, so that the first one of a segment lies before its index."""
    probes = t("customer").select(F.col("c_nationkey").alias("segment"), (F.col("c_custkey") - 1).alias("key"))
    return skipping.seek(probes, _index(t), "segment", "key")


@query("SELECT lang, count(*) AS n_keys, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY lang")
def segment_sizes(t):
    return t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.octet_length("text")).alias("n_bytes"))


# --- replication ----------------------------------------------------------------------------


def _murmur(source: str) -> str:
    """SQL: key and hash, MurmurHash3 of 32 bits with seed 0, of the keys of a source."""
    mix = lambda k: f"(({k}) * 3432918353 % 4294967296)"
    turn = lambda x, n: f"(({x}) * {1 << n} % 4294967296 + ({x}) // {1 << 32 - n})"
    scrambled = lambda k: f"({turn(mix(k), 15)} * 461845907 % 4294967296)"
    byte = "('0x' || substr(x, 2 * {} + 1, 2))::HUGEINT"
    block = " + ".join(f"{byte.format(f'(4 * i + {j})')} * {1 << 8 * j}" for j in range(4))
    rest = " + ".join(f"CASE WHEN n % 4 > {j} THEN {byte.format(f'(n // 4 * 4 + {j})')} * {1 << 8 * j} ELSE 0 END" for j in range(3))
    xor = lambda a, b: f"xor(({a})::BIGINT, ({b})::BIGINT)::HUGEINT"
    body = f"list_reduce(list_prepend(0::HUGEINT, list_transform(range(n // 4), lambda i: {scrambled(block)})), lambda h, k: ({turn(xor('h', 'k'), 13)} * 5 + 3864292196) % 4294967296)"
    shift = lambda h, n: xor(h, f"({h}) // {1 << n}")
    return f"""(SELECT key, CAST({shift('h', 16)} AS BIGINT) AS hash FROM (SELECT key, ({shift('h', 13)}) * 3266489909 % 4294967296 AS h FROM (SELECT key, ({shift('h', 16)}) * 2246822507 % 4294967296 AS h FROM
        (SELECT key, {xor(xor('h', scrambled(rest)), 'n')} AS h FROM (SELECT key, x, n, {body} AS h FROM (SELECT key, hex(encode(key)) AS x, strlen(key) AS n FROM ({source}))))))) """


_RING = f"SELECT min(hash) AS token, substr(key, 1, 2) AS node FROM {_murmur("SELECT 'n' || n || '-' || v AS key FROM range(5) a(n), range(8) b(v)")} GROUP BY hash, substr(key, 1, 2)"
_PLACED = f"""SELECT key, hash AS token, string_agg(node, ',' ORDER BY far) AS replicas FROM (SELECT key, hash, node, far, row_number() OVER (PARTITION BY key ORDER BY far) AS nth FROM
    (SELECT key, hash, node, min(CASE WHEN token >= hash THEN token - hash ELSE token - hash + 4294967296 END) AS far FROM {_murmur("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders")} k, ({_RING}) r GROUP BY 1, 2, 3)) WHERE nth <= 3 GROUP BY 1, 2"""


@query(_RING)
def ring_tokens(t):
    return ring.ring_table(t.spark, NODES)


@query(_PLACED)
def replicas_for(t):
    rows = ring.replicas(t("orders").select(F.col("o_orderkey").cast("string").alias("key")), F.col("key"), NODES, 3)
    return rows.withColumn("replicas", F.array_join("replicas", ","))


@query(f"SELECT key AS c_name, hash FROM {_murmur('SELECT c_name AS key FROM customer')}")
def murmur3_hash(t):
    return t("customer").select("c_name", murmur3_32("c_name").alias("hash"))


@query(f"SELECT hash % 16 AS shard, count(*) AS n_keys, min(key) AS low, max(key) AS high FROM {_murmur('SELECT p_name AS key FROM part')} GROUP BY 1")
def shard_sizes(t):
    """Keys dealt to 16 shards by their hash."""
    return t("part").select((murmur3_32("p_name") % 16).alias("shard"), "p_name").groupBy("shard").agg(F.count(F.lit(1)).alias("n_keys"), F.min("p_name").alias("low"), F.max("p_name").alias("high"))


@query("SELECT level, rf, CASE level WHEN 'ONE' THEN 1 WHEN 'QUORUM' THEN rf // 2 + 1 ELSE greatest(rf, 1) END AS required FROM (VALUES ('ONE'), ('QUORUM'), ('ALL')) AS l(level), (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS rf)")
def quorum_required(t):
    spark = t.spark
    rows = spark.range(8).select(F.col("id").cast("int").alias("rf"), F.explode(F.array(*map(F.lit, ["ONE", "QUORUM", "ALL"]))).alias("level"))
    return rows.select("level", "rf", ring.required(F.col("level"), F.col("rf")).alias("required"))


# Each order lies on three of five nodes; the second replica of some misses the last write.
_COPIES = """SELECT o_orderkey, (o_orderkey + i) % 5 AS node, CASE WHEN i = 1 AND o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS ts, CASE WHEN i = 1 AND o_orderkey % 3 = 0 THEN 'old' ELSE o_orderstatus END AS val
FROM orders, (VALUES (0), (1), (2)) AS r(i) WHERE NOT (i = 2 AND o_orderkey % 7 = 0)"""


def _copies(t):
    i, k = F.col("i"), F.col("o_orderkey")
    rows = t("orders").select("o_orderkey", "o_orderstatus", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).where(~((i == 2) & (k % 7 == 0)))
    old = (i == 1) & (k % 3 == 0)
    return rows.select("o_orderkey", ((k + i) % 5).alias("node"), F.when(old, 1).otherwise(2).alias("ts"), F.when(old, "old").otherwise(F.col("o_orderstatus")).alias("val"))


@query(f"SELECT o_orderkey, max(ts) AS ts, arg_max(val, ts) AS val FROM ({_COPIES}) WHERE node IN (0, 1, 3) GROUP BY o_orderkey")
def quorum_read(t):
    answered = t.spark.createDataFrame([(0, 1), (1, 2), (3, 3), (4, 4)], "node long, rank int")
    return replica.quorum_read(_copies(t), ["o_orderkey"], answered, 3, ["ts", "node"]).select("o_orderkey", "ts", "val")


@query(f"""SELECT e.o_orderkey, e.node, h.ts AS held_ts, 2 AS newest_ts FROM (SELECT o_orderkey, (o_orderkey + i) % 5 AS node FROM orders, (VALUES (0), (1), (2)) AS r(i)) e
LEFT JOIN ({_COPIES}) h ON h.o_orderkey = e.o_orderkey AND h.node = e.node WHERE h.ts IS NULL OR h.ts < 2""")
def read_repair_set(t):
    owners = t("orders").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).select("o_orderkey", ((F.col("o_orderkey") + F.col("i")) % 5).alias("node"))
    return replica.stale(_copies(t), ["o_orderkey"], owners, "ts").select("o_orderkey", "node", "held_ts", "newest_ts")


@query("""WITH log AS (SELECT event_id % 5 AS node, user_id, ts, value FROM events WHERE event_id % 5 <> 2), h AS (SELECT event_id % 5 AS node, user_id, ts, value FROM events WHERE event_id % 5 = 2)
SELECT node, user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM (SELECT * FROM log UNION ALL SELECT * FROM h) GROUP BY node, user_id""")
def hinted_handoff(t):
    rows = t("events").select((F.col("event_id") % 5).alias("node"), "user_id", "ts", "value")
    recovered = t.spark.createDataFrame([(2,)], "node long")
    return replica.after_replay(rows.where("node <> 2"), rows.where("node = 2"), recovered, ["user_id"], ["ts"])


@query("SELECT user_id, max(epoch(ts)) AS last_seen, (SELECT max(epoch(ts)) FROM events) - max(epoch(ts)) < 86400 AS alive FROM events GROUP BY user_id")
def liveness(t):
    seen = t("events").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("last_seen"))
    now = t("events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"))
    return seen.join(F.broadcast(now)).select("user_id", "last_seen", ring.alive(F.col("last_seen"), F.col("now"), 86400).alias("alive"))


@query(f"SELECT o_orderkey, arg_max(val, ts) AS val, count(*) AS n_copies FROM ({_COPIES}) GROUP BY o_orderkey")
def replica_union(t):
    merged = latest_values(_copies(t), ["o_orderkey"], ["ts"], ["val"])
    return merged.join(_copies(t).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_copies")), "o_orderkey")


@query("SELECT user_id AS slot, event_id AS salt, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def paxos_ballot(t):
    return replica.ballots(t("events").select(F.col("user_id").alias("slot"), F.col("event_id").alias("salt"), "ts"), ["slot"], "ts", "salt")


@query("SELECT count(DISTINCT o_orderkey) AS n_merged, count(*) FILTER (node = 0) AS n_first_replica FROM (" + _COPIES + ")")
def count_merge(t):
    return _copies(t).agg(F.countDistinct("o_orderkey").alias("n_merged"), F.count_if(F.col("node") == 0).alias("n_first_replica"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 <= 1 THEN 1 WHEN p_size % 7 >= p_size % 5 THEN greatest(p_size % 5, 1) ELSE p_size % 5 // 2 + 1 END AS required FROM part")
def numeric_levels(t):
    """Levels as numbers (p_size % 7) for p_size % 5 copies."""
    return t("part").select("p_partkey", ring.required((F.col("p_size") % 7).cast("string"), F.col("p_size") % 5).alias("required"))


@query("SELECT s_suppkey, s_suppkey % 3 <> 0 AND s_acctbal >= 0.05 * 10000 AS healthy FROM supplier")
def self_health(t):
    """Every third node is in panic; s_acctbal stands for free space of 10,000."""
    until = F.when(F.col("s_suppkey") % 3 == 0, 200)
    return t("supplier").select("s_suppkey", ring.healthy(F.lit(100), until, F.col("s_acctbal"), F.lit(10000)).alias("healthy"))


_OWNERS = "SELECT o_orderkey, (o_orderkey + i) % 5 AS node FROM orders, (VALUES (0), (1), (2)) AS r(i)"


def _owners(t):
    return t("orders").select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).select("o_orderkey", ((F.col("o_orderkey") + F.col("i")) % 5).alias("node"))


def _nodes(t):
    return t.spark.createDataFrame([(i, i not in (2, 3)) for i in range(5)], "node long, up boolean")


@query(f"SELECT o_orderkey, count(*) FILTER (node NOT IN (2, 3)) AS n_acks, count(*) FILTER (node NOT IN (2, 3)) >= 2 AS ok FROM ({_OWNERS}) GROUP BY 1")
def write_quorum(t):
    """A write of each order to its three replicas, two nodes of five down, at QUORUM."""
    return replica.write_outcome(_owners(t), _nodes(t), ["o_orderkey"], 2)[0]


@query(f"SELECT o_orderkey, node FROM ({_OWNERS}) WHERE node IN (2, 3)")
def write_hints(t):
    return replica.write_outcome(_owners(t), _nodes(t), ["o_orderkey"], 2)[1]


@query("""SELECT event_id, event_id % 5 AS node, event_id < coalesce((SELECT min(f.event_id) FROM events f WHERE f.event_type = 'error' AND f.event_id % 5 = e.event_id % 5 AND f.event_id % 100 > 90), 1000000000000) AS delivered FROM events e""")
def hint_requeue(t):
    """Hints in order of their ids; some errors fail on replay."""
    hints = t("events").select("event_id", (F.col("event_id") % 5).alias("node"), "event_type")
    return replica.replay_until_failure(hints, "event_id", (F.col("event_type") == "error") & (F.col("event_id") % 100 > 90)).select("event_id", "node", "delivered")


@query("""SELECT DISTINCT statement, node FROM (SELECT 's' || o_custkey AS statement, (o_orderkey + i) % 5 AS node FROM orders, (VALUES (0), (1), (2)) AS r(i) WHERE o_custkey % 10 <> 0
UNION ALL SELECT 's' || o_custkey, n FROM orders, range(5) x(n) WHERE o_custkey % 10 = 0 AND o_custkey % 20 <> 0 UNION ALL SELECT 's' || o_custkey, o_custkey % 5 FROM orders WHERE o_custkey % 20 = 0)""")
def statement_targets(t):
    """A customer's orders as the keys of a statement; some statements are for all nodes, some for one's own."""
    c = F.col("o_custkey")
    kind = F.when(c % 20 == 0, "self").when(c % 10 == 0, "broadcast").otherwise("keys")
    rows = t("orders").select(F.concat(F.lit("s"), c).alias("statement"), kind.alias("kind"), (c % 5).alias("home"), "o_orderkey")
    return ring.targets(rows, _owners(t), _nodes(t), "statement", ["o_orderkey"])


@query("SELECT event_type, max(n) AS n FROM (SELECT event_type, event_id % 5 AS node, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def mutation_count_merge(t):
    answers = t("events").groupBy("event_type", (F.col("event_id") % 5).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return replica.merged_counts(answers, "event_type", "n")


@query("SELECT DISTINCT lower(p_brand) AS name FROM part")
def table_names_merge(t):
    answers = t("part").select((F.col("p_partkey") % 5).alias("node"), F.lower("p_brand").alias("name")).distinct()
    return replica.merged_names(answers, "name")


# --- the engine on whole tables -------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT min(o_orderkey) FROM orders UNION ALL SELECT max(o_orderkey) FROM orders) AND o_custkey <> 7
UNION ALL SELECT o_custkey, o_orderkey, 'U', o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT 0, 0, 'N', 1.5""")
def engine_orders(t):
    """All orders through INSERT ... SELECT (twice: the second time changes nothing), then UPDATE,
    DELETE, a prefix delete, INSERT, compaction and a restart; read back whole."""
    from .engine import Engine

    e = _engine(t)
    t("orders").createOrReplaceTempView("engine_source")
    ends = t("orders").agg(F.min(F.struct("o_orderkey", "o_custkey")).alias("a"), F.max(F.struct("o_orderkey", "o_custkey")).alias("b")).first()
    e.sql("CREATE TABLE wide (o_custkey INT, o_orderkey INT, o_orderstatus TEXT, o_totalprice DOUBLE, PRIMARY KEY(o_custkey, o_orderkey))")
    for _ in range(2):
        e.sql("INSERT INTO wide SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM engine_source")
    e.delete_prefix("wide", o_custkey=7)
    low, high = ends["a"], ends["b"]
    e.sql(f"DELETE FROM wide WHERE o_custkey = {low[1]} AND o_orderkey = {low[0]}")
    e.sql(f"UPDATE wide SET o_orderstatus = 'U', o_totalprice = {_price(t, high[0])} WHERE o_custkey = {high[1]} AND o_orderkey = {high[0]}")
    e.sql("INSERT INTO wide VALUES (0, 0, 'N', 1.5)")
    e.compact("wide")
    return Engine(t.spark, e.log.root).sql("SELECT * FROM wide")


def _price(t, key: int) -> str:
    return repr(t("orders").where(F.col("o_orderkey") == key).first()["o_totalprice"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (" + _LATEST + ") WHERE l_orderkey IN (1, 2, 3, 500)")
def compacted_lookup(t):
    """A lookup in compacted segments: sorted by key, so that statistics and Bloom filters skip files."""
    from .sources.log import Log
    from .spec import TableSpec

    log = Log(t.spark, f"{shared_folder(t.spark)}/log-{uuid.uuid4().hex}")
    rows = t("lineitem").select(*KEYS, "l_quantity", F.struct(*ORDER).alias("v"))
    rows = latest(rows, KEYS, ["v"]).drop("v").withColumn("__ts", F.lit(1).cast("long")).withColumn("__seq", F.lit(1).cast("long")).withColumn("__deleted", F.lit(False))
    spec = TableSpec("lineitem", ("l_orderkey",), ("l_linenumber",), rows.select(*KEYS, "l_quantity").schema)
    log.append(spec, 1, rows)
    log.compact(spec, 1, 8)
    return log.rows(spec, 2).where(F.col("l_orderkey").isin(1, 2, 3, 500))


# --- streaming ------------------------------------------------------------------------------


@query("SELECT user_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_lww(t):
    """events as a file stream into the log, then the newest row of each user."""
    spark = t.spark
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # A stream reads a folder or a pattern; the table may be one file, so it is given as a pattern.
    stream = spark.readStream.schema(t("events").schema).parquet(f"{t.folder}/events.[p]arquet")
    ingest(stream, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return resolved(spark.read.parquet(f"{root}/log"), ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "event_type", "value")


# --- analytic extensions, planned by Spark --------------------------------------------------


@query("SELECT n_name, sum(o_totalprice) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name".replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)"))
def join_inner(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT e.event_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e""")
def join_asof(t):
    """The last purchase at or before each event: one window over the user's events."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return t("events").select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w).alias("last_purchase"))


@query("SELECT p_brand, p_partkey, r FROM (SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def window_rank(t):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return t("part").select("p_brand", "p_partkey", F.rank().over(w).cast("long").alias("r")).where("r <= 3")


@query("SELECT event_id, value - lag(value) OVER w AS delta, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("value - lag(value) OVER w", "round(value - lag(value) OVER w, 4)").replace("avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4)"))
def window_frames(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 4).alias("delta"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 4).alias("mean_3"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0 UNION SELECT 99")
def set_operations(t):
    one = t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))
    return one.subtract(t("nation").where("n_regionkey = 0").select("n_nationkey")).union(t.spark.range(1).select(F.lit(99).alias("k"))).distinct()


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(t):
    return t("events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sql, keys FROM (VALUES ('SELECT * FROM orders WHERE o_custkey = 1', 'o_custkey'), ('SELECT * FROM orders WHERE o_orderkey IN (1, 2) AND o_custkey = 3', 'o_custkey,o_orderkey')) AS x(sql, keys)")
def bound_keys(t):
    found = []
    for text in ("SELECT * FROM orders WHERE o_custkey = 1", "SELECT * FROM orders WHERE o_orderkey IN (1, 2) AND o_custkey = 3"):
        bound = parse(text).bound
        found.append((text, ",".join(k for k in ("o_custkey", "o_orderkey") if k in bound)))
    return t.spark.createDataFrame(found, "sql string, keys string")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), top AS (SELECT * FROM big WHERE total > (SELECT avg(total) FROM big)) SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM top)")
def cte_subquery(t):
    t("orders").createOrReplaceTempView("cte_orders"), t("customer").createOrReplaceTempView("cte_customer")
    return t.spark.sql("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM cte_orders GROUP BY 1), top AS (SELECT * FROM big WHERE total > (SELECT avg(total) FROM big)) SELECT c_custkey, c_mktsegment FROM cte_customer WHERE c_custkey IN (SELECT o_custkey FROM top)")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def group_cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(t):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return t("lineitem").groupingSets([[a], [b], []], a, b).agg(F.sum("l_quantity").alias("quantity")).select("l_returnflag", "l_linestatus", "quantity")


@query("SELECT coalesce(c_custkey, k) AS key, c_custkey IS NULL AS only_right, k IS NULL AS only_left FROM customer FULL JOIN (SELECT o_custkey + 100 AS k FROM orders GROUP BY 1) o ON c_custkey = k")
def join_full(t):
    o = t("orders").select((F.col("o_custkey") + 100).alias("k")).distinct()
    return t("customer").join(o, F.col("c_custkey") == F.col("k"), "full").select(F.coalesce("c_custkey", "k").alias("key"), F.col("c_custkey").isNull().alias("only_right"), F.col("k").isNull().alias("only_left"))


@query("SELECT e.event_id, count(p.event_id) AS n FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts BETWEEN e.ts - INTERVAL 1 DAY AND e.ts GROUP BY 1")
def join_range(t):
    """Events of the day before each event: a range frame over the user's events, no pairs."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-86_400_000_000, Window.currentRow)
    return t("events").select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT c_custkey, upper(c_mktsegment) AS segment, len(string_split(c_name, '#')) AS n_parts, list_sum(list_transform(range(1, 4), lambda x: x * c_nationkey))::BIGINT AS total, replace(c_name, 'Customer', 'C') AS short FROM customer")
def text_and_array_functions(t):
    return t("customer").select(
        "c_custkey", F.upper("c_mktsegment").alias("segment"), F.size(F.split("c_name", "#")).cast("long").alias("n_parts"),
        F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda x: x * F.col("c_nationkey")), F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.replace("c_name", F.lit("Customer"), F.lit("C")).alias("short"),
    )


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t):
    """Counts per day and kind as a streaming aggregate, each batch's answer merged by the last one."""
    spark, schema = t.spark, t("events").schema
    root = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{t.folder}/events.[p]arquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(stream, "ts", "1 day", "1 day", ["event_type"], "30 days")
    write = lambda df, number: df.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/out").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "batch")
    return latest(rows, ["event_type", "day"], ["batch"]).drop("batch")
