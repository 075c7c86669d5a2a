"""Row changes, snapshots and feeds over the driver's tables, as registered queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dml
from tessera.session import load, scratch
from tessera.streaming import windows


def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations merged with two rows, of which one is new."""
    nation = load(spark, sf_dir, "nation")
    new = spark.sql("SELECT 3 AS n_nationkey, 'RENAMED' AS n_name, 1 AS n_regionkey UNION ALL SELECT 99, 'NEW', 2")
    return dml.upsert(nation, new, ["n_nationkey"], {"n_name": F.col("excluded.n_name")})


def dml_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    new = spark.sql("SELECT 3 AS n_nationkey, 'RENAMED' AS n_name, 0 AS n_regionkey UNION ALL SELECT 99, 'NEW', 2")
    return dml.upsert(nation, new, ["n_nationkey"])


def dml_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    new = spark.sql("SELECT 3 AS n_nationkey, 'RENAMED' AS n_name, 0 AS n_regionkey UNION ALL SELECT 99, 'NEW', 2")
    return nation.unionByName(dml.without_conflicts(new, nation, ["n_nationkey"]))


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dml.update(orders, F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.delete(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F")


def dml_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that live for a day, as seen on a day in the middle of the data."""
    events = load(spark, sf_dir, "events").select("event_id", "ts")
    now = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.col("a") + (F.col("b") - F.col("a")) / 2).alias("now"))
    live = events.withColumn("expires", F.col("ts") + F.expr("INTERVAL 1 DAY")).withColumn("now", now.scalar())
    return dml.unexpired(live, "expires", F.col("now")).select("event_id")


def dml_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements on a table of its own: insert from a query, update, delete, upsert, then the rows."""
    from tessera.database import Database

    db = Database(spark, scratch(spark, "db"), clock=lambda: 1000.0)
    db.sql("CREATE TABLE cust (id BIGINT PRIMARY KEY, segment TEXT NOT NULL, balance DOUBLE DEFAULT 0.0)")
    db.insert_rows("cust", load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    db.sql("UPDATE cust SET balance = balance + 10 WHERE segment = 'BUILDING'")
    db.sql("DELETE FROM cust WHERE balance < 0")
    db.sql("INSERT INTO cust VALUES (1, 'MADE', 5.0), (1000001, 'MADE', 6.0) ON CONFLICT (id) DO UPDATE SET segment = 'SEEN'")
    return db.sql("SELECT id, segment, balance FROM cust")


def history_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per action of a table with history."""
    from tessera.database import Database

    db = Database(spark, scratch(spark, "db"), clock=lambda: 1000.0)
    db.sql("CREATE TABLE nat (id INT, name TEXT) WITH HISTORY")
    db.insert_rows("nat", load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    db.sql("UPDATE nat SET name = 'X' WHERE id < 5")
    db.sql("DELETE FROM nat WHERE id >= 20")
    return db.sql("SELECT history_action, id, name FROM _history_nat")


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version from before a delete, read after it."""
    from tessera.database import Database

    root = scratch(spark, "db")
    db = Database(spark, root)
    db.sql("CREATE TABLE nat (id INT, name TEXT)")
    db.insert_rows("nat", load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    version = db.manifest["version"]
    db.sql("DELETE FROM nat")
    return Database(spark, root, at=version).table("nat")


def attached_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of a table with one of an attached database."""
    from tessera.database import Database

    other = Database(spark, path := scratch(spark, "aux"))
    other.sql("CREATE TABLE reg (id INT, name TEXT)")
    other.insert_rows("reg", load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    db = Database(spark, scratch(spark, "db"))
    db.sql(f"ATTACH DATABASE '{path}' AS aux")
    return db.sql("SELECT n_name, r.name AS region FROM nation JOIN aux.reg AS r ON n_regionkey = r.id")


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations through the CSV module."""
    from tessera.database import Database

    path = scratch(spark, "csv")
    load(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    db = Database(spark, scratch(spark, "db"))
    db.sql(f"CREATE VIRTUAL TABLE nat USING csv('{path}')")
    return db.sql("SELECT n_nationkey, n_name FROM nat WHERE n_nationkey > 3")


def view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view with a filter, a sort and a limit around it."""
    from tessera.database import Database

    load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    db = Database(spark, scratch(spark, "db"))
    db.sql("CREATE VIEW rich AS SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_acctbal > 5000 OR c_nationkey = 1")
    return db.sql("SELECT c_custkey, c_acctbal FROM rich WHERE c_nationkey < 5 ORDER BY c_acctbal DESC, c_custkey LIMIT 15")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per type from a stream of events, with a watermark."""
    return windows.tumbling(spark, sf_dir)


QUERIES = (dml_upsert, dml_replace, dml_insert_ignore, dml_update, dml_delete, dml_ttl, dml_statements, history_feed, snapshot_read, attached_join, csv_scan, view_scan, stream_windows)

ORACLES = {
    "dml_upsert": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NEW', 2",
    "dml_replace": "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 3, 'RENAMED', 0 UNION ALL SELECT 99, 'NEW', 2",
    "dml_insert_ignore": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NEW', 2",
    "dml_update": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders",
    "dml_delete": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "dml_ttl": "SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)",
    "dml_statements": "WITH c AS (SELECT c_custkey AS id, c_mktsegment AS segment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS balance FROM customer), d AS (SELECT * FROM c WHERE balance >= 0) SELECT id, CASE WHEN id = 1 THEN 'SEEN' ELSE segment END AS segment, balance FROM d UNION ALL SELECT * FROM (VALUES (1, 'MADE', 5.0::DOUBLE), (1000001, 'MADE', 6.0::DOUBLE)) AS v(id, segment, balance) WHERE id NOT IN (SELECT id FROM d)",
    "history_feed": "SELECT 'INSERT' AS history_action, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'UPDATE', n_nationkey, 'X' FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'DELETE', n_nationkey, n_name FROM nation WHERE n_nationkey >= 20",
    "snapshot_read": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "attached_join": "SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "csv_scan": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 3",
    "view_scan": "SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal > 5000 OR c_nationkey = 1) AND c_nationkey < 5 ORDER BY c_acctbal DESC, c_custkey LIMIT 15",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
