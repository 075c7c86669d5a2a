"""Statements of the database layer over the driver's tables, as registered queries with their SQL.

Each query fills tables of its own with whole tables of the driver, runs statements on them and
returns the rows that are there afterwards, or those that the last statement returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.database import Database
from tessera.operators.dml import ConstraintError
from tessera.session import load, scratch
from tessera.streaming import changes, windows

_NATION = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"


def _nations(spark: SparkSession, sf_dir: str, ddl: str = "CREATE TABLE nat (id INT PRIMARY KEY, name TEXT, region INT)") -> Database:
    db = Database(spark, scratch(spark, "db"), clock=lambda: 1000.0)
    db.sql(ddl)
    db.insert_rows("nat", load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return db


def _refused(db: Database, *statements: str) -> int:
    """How many of the statements are refused by a constraint."""
    n = 0
    for text in statements:
        try:
            db.sql(text)
        except ConstraintError:
            n += 1
    return n


def dml_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as an update leaves them."""
    return _nations(spark, sf_dir).sql("UPDATE nat SET name = lower(name), region = region + 10 WHERE region = 2 RETURNING id, name, region AS moved")


def dml_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert from a query with a column list and a default."""
    db = _nations(spark, sf_dir)
    db.sql("CREATE TABLE few (id INT PRIMARY KEY, kind TEXT DEFAULT 'plain', name TEXT)")
    db.sql("INSERT INTO few (name, id) SELECT name, id FROM nat WHERE id % 3 = 0")
    return db.sql("SELECT * FROM few")


def dml_autoincrement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the table gives, after two inserts of all customers."""
    db = Database(spark, scratch(spark, "db"))
    db.sql("CREATE TABLE log (id BIGINT AUTOINCREMENT PRIMARY KEY, customer BIGINT)")
    for _ in range(2):
        db.insert_rows("log", load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")))
    return db.sql("SELECT customer, count(DISTINCT id) AS keys, max(id) <= (SELECT count(*) FROM log) AS dense FROM log GROUP BY customer")


def dml_conflict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat within a statement: the first stays, the last wins, or all are applied in turn."""
    db = _nations(spark, sf_dir)
    db.sql("INSERT OR IGNORE INTO nat VALUES (100, 'first', 0), (100, 'second', 0)")
    db.sql("INSERT OR REPLACE INTO nat VALUES (3, 'early', 7), (3, 'late', 8), (101, 'x', 1), (101, 'y', 2)")
    db.sql("INSERT INTO nat VALUES (4, 'a', 1), (4, 'b', 2), (102, 'c', 5), (102, 'd', 6) ON CONFLICT (id) DO UPDATE SET name = name || '+' || excluded.name, region = region + excluded.region")
    return db.sql("SELECT * FROM nat")


def dml_bulk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals per customer by upserts of all orders, whose keys repeat."""
    db = Database(spark, scratch(spark, "db"))
    db.sql("CREATE TABLE spent (customer BIGINT PRIMARY KEY, orders BIGINT)")
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("customer"), F.lit(1).cast("long").alias("orders"))
    db.insert_rows("spent", rows, on="UPDATE", sets={"orders": "orders + excluded.orders"})
    return db.sql("SELECT customer, orders FROM spent")


def dml_subquery_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete whose subquery sees what another writer has just committed."""
    db = _nations(spark, sf_dir)
    db.sql("CREATE TABLE keep (id INT)")
    other = Database(spark, db.store.root)
    other.sql("INSERT INTO keep SELECT id FROM nat WHERE region < 3")
    db.sql("DELETE FROM nat WHERE id NOT IN (SELECT id FROM keep)")
    return db.sql("SELECT * FROM nat")


def ddl_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted and changed regions take their nations along; a plain reference refuses."""
    db = Database(spark, scratch(spark, "db"))
    db.sql("CREATE TABLE reg (id INT PRIMARY KEY); CREATE TABLE nat (id INT PRIMARY KEY, name TEXT, region INT REFERENCES reg(id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.sql("CREATE TABLE strict (id INT PRIMARY KEY, region INT REFERENCES reg(id))")
    db.insert_rows("reg", load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")))
    db.insert_rows("nat", load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    db.sql("INSERT INTO strict VALUES (1, 4)")
    refused = _refused(db, "DELETE FROM reg WHERE id = 4", "UPDATE reg SET id = 44 WHERE id = 4", "INSERT INTO nat VALUES (900, 'NOWHERE', 77)")
    db.sql("DELETE FROM reg WHERE id = 1; UPDATE reg SET id = 20 WHERE id = 2")
    return db.sql(f"SELECT id, name, region, {refused} AS refused FROM nat")


def ddl_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks a constraint leaves nothing behind."""
    db = _nations(spark, sf_dir, "CREATE TABLE nat (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL UNIQUE, region INT CHECK (region < 10), kind TEXT DEFAULT 'land')")
    refused = _refused(
        db,
        "INSERT INTO nat VALUES (0, 'twice', 1, 'x')",
        "INSERT INTO nat VALUES (500, NULL, 1, 'x')",
        "INSERT INTO nat VALUES (501, 'far', 10, 'x'), (502, 'fine', 1, 'x')",
        "INSERT INTO nat SELECT id + 1000, name, region, kind FROM nat WHERE id = 7",
        "INSERT INTO nat VALUES (503, 'a name of more than twenty letters', 1, 'x')",
        "UPDATE nat SET region = region + 8",
    )
    return db.sql(f"SELECT id, name, region, kind, {refused} AS refused FROM nat")


def ddl_unique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique indexes over expressions and parts of a table hold until they are dropped."""
    db = _nations(spark, sf_dir)
    refused = _refused(db, "CREATE UNIQUE INDEX per_region ON nat (region)")
    db.sql("CREATE UNIQUE INDEX folded ON nat (lower(name)); CREATE UNIQUE INDEX some ON nat (region) WHERE id >= 600")
    refused += _refused(db, "INSERT INTO nat SELECT id + 100, lower(name), region FROM nat WHERE id = 2", "INSERT INTO nat VALUES (600, 'p', 1), (601, 'q', 1)")
    db.sql("DROP INDEX folded; DROP INDEX some")
    db.sql("INSERT INTO nat SELECT id + 100, lower(name), region FROM nat WHERE id = 2; INSERT INTO nat VALUES (600, 'p', 1), (601, 'q', 1)")
    return db.sql(f"SELECT id, name, region, {refused} AS refused FROM nat")


def ddl_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A renamed table with a column added, and one dropped and added again, which is empty then."""
    db = _nations(spark, sf_dir)
    db.sql("ALTER TABLE nat RENAME TO land; ALTER TABLE land ADD COLUMN area DOUBLE DEFAULT 1.5")
    db.sql("ALTER TABLE land DROP COLUMN region; ALTER TABLE land ADD COLUMN region TEXT")
    db.sql("UPDATE land SET region = 'set' WHERE id < 3")
    return db.sql("SELECT id, name, area, region FROM land")


def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that are left."""
    db = _nations(spark, sf_dir, "CREATE TABLE nat (id INT PRIMARY KEY, name TEXT, region INT) WITH HISTORY")
    db.sql("CREATE TABLE IF NOT EXISTS nat (id INT); CREATE TABLE gone (id INT); CREATE VIEW v AS SELECT id FROM nat; DROP VIEW v; DROP TABLE gone; DROP TABLE IF EXISTS gone; REINDEX nat")
    return db.sql("PRAGMA tables")


def ddl_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of every changed row, and a counter that is raised once per row by what the row holds."""
    db = _nations(spark, sf_dir)
    db.sql("CREATE TABLE log (id INT PRIMARY KEY, was TEXT, now TEXT); CREATE TABLE tally (region INT PRIMARY KEY, n INT)")
    db.sql("INSERT INTO tally SELECT DISTINCT region, 0 FROM nat")
    db.sql("CREATE TRIGGER logged AFTER UPDATE ON nat BEGIN INSERT INTO log VALUES (NEW.id, OLD.name, NEW.name); END")
    db.sql("CREATE TRIGGER counted AFTER DELETE ON nat BEGIN UPDATE tally SET n = n + OLD.id WHERE region = OLD.region; END")
    db.sql("UPDATE nat SET name = lower(name) WHERE region = 3; DELETE FROM nat WHERE id >= 20")
    return db.sql("SELECT id, was, now FROM log UNION ALL SELECT region, 'tally', CAST(n AS TEXT) FROM tally")


def ddl_index_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    db.sql("CREATE INDEX by_name ON nat (name); CREATE INDEX by_two ON nat (region, name); CREATE INDEX partly ON nat (lower(name)) WHERE region = 1")
    return db.sql("PRAGMA index_list(nat)")


def ddl_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir, "CREATE TABLE nat (id INT PRIMARY KEY, name TEXT NOT NULL, region INT DEFAULT 4)").sql("PRAGMA table_info(nat)")


def tx_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions and savepoints that are rolled back leave nothing, released ones stay."""
    db = _nations(spark, sf_dir)
    db.sql("BEGIN; DELETE FROM nat; ROLLBACK")
    db.sql("BEGIN; DELETE FROM nat WHERE region = 0; SAVEPOINT a; DELETE FROM nat WHERE region = 1; SAVEPOINT b; DELETE FROM nat; ROLLBACK TO b; RELEASE b; COMMIT")
    db.sql("BEGIN; UPDATE nat SET name = 'x'; SAVEPOINT c; DELETE FROM nat; ROLLBACK TO c; ROLLBACK")
    return db.sql("SELECT * FROM nat")


def tx_fresh_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that was open before a commit sees it; one that is in a transaction doesn't."""
    db = _nations(spark, sf_dir)
    reader, busy = Database(spark, db.store.root), Database(spark, db.store.root)
    busy.sql("BEGIN")
    db.sql("DELETE FROM nat WHERE region <> 2")
    kept = busy.sql("SELECT count(*) AS n FROM nat").first()["n"]
    return reader.sql(f"SELECT id, name, region, CAST({kept} AS BIGINT) AS before FROM nat")


def maint_backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup restored to the version before an update."""
    db = _nations(spark, sf_dir)
    bound = db.manifest["version"]
    db.sql("UPDATE nat SET name = 'changed'")
    path = scratch(spark, "backup")
    db.sql(f"BACKUP DATABASE TO '{path}'; RESTORE DATABASE FROM '{path}' UNTIL LSN {bound} TO '{path}-restored'")
    return Database(spark, f"{path}-restored").sql("SELECT * FROM nat")


def maint_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows after a vacuum, in a vacuumed copy and after old versions were forgotten."""
    db = _nations(spark, sf_dir)
    path = scratch(spark, "vacuumed")
    db.sql(f"DELETE FROM nat WHERE region = 0; VACUUM; VACUUM INTO '{path}'; PRAGMA vacuum_mvcc")
    db.sql(f"ATTACH DATABASE '{path}' AS copied")
    return db.sql("SELECT 'here' AS place, id, name FROM nat UNION ALL SELECT 'there', id, name FROM copied.nat")


def maint_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    db.sql("CREATE INDEX by_region ON nat (region); DELETE FROM nat WHERE region = 1; ANALYZE")
    return db.sql("SELECT tbl, idx, stat FROM sqlite_stat1")


def maint_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired rows are unseen, then counted as they are dropped."""
    now = [1000.0]
    db = Database(spark, scratch(spark, "db"), clock=lambda: now[0])
    db.sql("CREATE TABLE nat (id INT PRIMARY KEY, name TEXT) WITH TTL = 50")
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    db.insert_rows("nat", rows.filter("id % 2 = 0"))
    db.insert_rows("nat", rows.filter("id % 2 = 1"), ttl=500)
    now[0] += 100
    reaped = db.sql("PRAGMA reap_expired(nat)").first()["reaped"]
    return db.sql(f"SELECT id, name, CAST({reaped} AS BIGINT) AS reaped FROM nat")


def maint_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    found = db.sql("PRAGMA integrity_check").first()[0]
    return db.sql(f"SELECT id, '{found}' AS checked, '{db.sql('PRAGMA journal_mode').first()[0]}' AS journal FROM nat")


def maint_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an analysed query made, by its own measure, and whether its plan says that it ran."""
    db = _nations(spark, sf_dir)
    lines = [r["plan"] for r in db.sql("EXPLAIN ANALYZE SELECT region, count(*) AS n FROM nat GROUP BY region").collect()]
    rows = next(x for x in lines if x.startswith("rows: ")).removeprefix("rows: ")
    plan = db.sql("EXPLAIN QUERY PLAN SELECT region FROM nat WHERE id = 3")
    return plan.filter("plan LIKE '%PushedFilters%EqualTo(id,3)%'").select(F.lit(int(rows)).cast("long").alias("n"), F.lit(any("number of output rows=" in x for x in lines)).alias("measured"))


def api_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).sql("SELECT id, name FROM nat WHERE region = ? AND name >= ?2 OR id = ?3", [1, "C", 24])


def api_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stepped through by a prepared statement, which is bound and run twice."""
    statement = _nations(spark, sf_dir).prepare("SELECT id, name FROM nat WHERE region = ?1")
    found = []
    for region in (0, 3):
        statement.bind(1, region)
        while statement.step():
            found.append((statement.column(0), statement.column(1)))
        statement.reset()
    return spark.createDataFrame(found, "id int, name string")


def api_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows changed by an insert, an update and a delete, and the last key that was inserted."""
    db = _nations(spark, sf_dir)
    found = [(db.changes, db.last_insert_rowid)]
    for text in ("INSERT INTO nat VALUES (70, 'p', 1), (71, 'q', 1)", "UPDATE nat SET name = 'r' WHERE region = 1", "DELETE FROM nat WHERE id >= 70"):
        db.sql(text)
        found.append((db.changes, db.last_insert_rowid))
    return spark.createDataFrame([(i, n, last) for i, (n, last) in enumerate(found)], "turn int, changed long, last long")


def api_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions of all tables, as .schema shows them."""
    db = _nations(spark, sf_dir)
    db.sql("CREATE TABLE small (id INT PRIMARY KEY, v VARCHAR(5) NOT NULL DEFAULT 'x')")
    return db.sql(".schema")


def fts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a text-search table that hold a phrase in either column."""
    db = Database(spark, scratch(spark, "db"))
    db.sql("CREATE VIRTUAL TABLE docs USING fts5(title, body)")
    db.insert_rows("docs", load(spark, sf_dir, "documents").select((F.col("doc_id") + 1).cast("int").alias("id"), F.col("lang").alias("title"), F.col("text").alias("body")))
    return db.sql("SELECT id FROM docs WHERE docs MATCH 'LICENSE'")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per type in windows of two hours that begin every hour."""
    events = windows.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = windows.drain(windows.sliding(events, "2 hours", "1 hour", "1 hour", ["event_type"]))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, which end after an hour without an event."""
    events = windows.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = windows.drain(windows.sessions(events, "1 hour", "1 hour", ["user_id"]))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of a table, read as a stream."""
    db = _nations(spark, sf_dir, "CREATE TABLE nat (id INT PRIMARY KEY, name TEXT, region INT) WITH HISTORY")
    db.sql("UPDATE nat SET name = 'new' WHERE region = 4; DELETE FROM nat WHERE region = 0")
    return windows.drain(changes.change_feed(db, "nat"), "append").select("history_id", "history_action", "id", "name")


def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stream whose time hasn't passed: every other event is said to expire in 1970."""
    events = windows.event_stream(spark, sf_dir).withColumn("until", F.when(F.col("event_id") % 2 == 0, F.lit(1).cast("long")))
    return windows.drain(changes.expire_stream(events, "until"), "append").select("event_id")


def notify_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that a listener hears, in the order in which they were sent."""
    channel, heard = changes.Channel(spark, scratch(spark, "channels"), "news"), []
    for row in load(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        channel.notify(row["r_name"])
    channel.listen(heard.append, scratch(spark, "heard")).awaitTermination()
    return spark.createDataFrame(list(enumerate(heard)), "turn int, message string")


QUERIES = (
    dml_returning, dml_insert_select, dml_autoincrement, dml_conflict_order, dml_bulk_fold, dml_subquery_delete, ddl_cascades, ddl_constraints, ddl_unique_index, ddl_alter, ddl_drop, ddl_triggers,
    ddl_index_list, ddl_table_info, tx_rollback, tx_fresh_read, maint_backup_restore, maint_vacuum, maint_analyze, maint_reap, maint_integrity, maint_explain, api_parameters, api_cursor, api_changes,
    api_schema, fts_table, stream_sliding, stream_sessions, stream_change_feed, stream_expiry, notify_channel,
)

ORACLES = {
    "dml_returning": "SELECT n_nationkey AS id, lower(n_name) AS name, (n_regionkey + 10)::INT AS moved FROM nation WHERE n_regionkey = 2",
    "dml_insert_select": "SELECT n_nationkey AS id, 'plain' AS kind, n_name AS name FROM nation WHERE n_nationkey % 3 = 0",
    "dml_autoincrement": "SELECT c_custkey::BIGINT AS customer, 2::BIGINT AS keys, true AS dense FROM customer",
    "dml_conflict_order": f"SELECT id, CASE id WHEN 3 THEN 'late' WHEN 4 THEN name || '+a+b' ELSE name END AS name, CASE id WHEN 3 THEN 8 WHEN 4 THEN region + 3 ELSE region END::INT AS region FROM ({_NATION}) UNION ALL VALUES (100, 'first', 0), (101, 'y', 2), (102, 'c+d', 11)",
    "dml_bulk_fold": "SELECT o_custkey::BIGINT AS customer, count(*) AS orders FROM orders GROUP BY o_custkey",
    "dml_subquery_delete": f"SELECT * FROM ({_NATION}) WHERE region < 3",
    "ddl_cascades": f"SELECT id, name, CASE region WHEN 2 THEN 20 ELSE region END::INT AS region, 3 AS refused FROM ({_NATION}) WHERE region <> 1",
    "ddl_constraints": f"SELECT id, name, region, 'land' AS kind, 6 AS refused FROM ({_NATION})",
    "ddl_unique_index": f"SELECT id, name, region, 3 AS refused FROM ({_NATION}) UNION ALL SELECT id + 100, lower(name), region, 3 FROM ({_NATION}) WHERE id = 2 UNION ALL VALUES (600, 'p', 1, 3), (601, 'q', 1, 3)",
    "ddl_alter": f"SELECT id, name, 1.5::DOUBLE AS area, CASE WHEN id < 3 THEN 'set' END AS region FROM ({_NATION})",
    "ddl_drop": "SELECT * FROM (VALUES ('_history_nat'), ('nat')) AS t(name)",
    "ddl_triggers": f"SELECT id, name AS was, lower(name) AS now FROM ({_NATION}) WHERE region = 3 UNION ALL SELECT region, 'tally', sum(CASE WHEN id >= 20 THEN id ELSE 0 END)::INT::VARCHAR FROM ({_NATION}) GROUP BY region",
    "ddl_index_list": "SELECT * FROM (VALUES (0, 'by_name', 0, 'name', 0), (1, 'by_two', 0, 'region, name', 0), (2, 'partly', 0, 'lower(name)', 1)) AS t(seq, name, \"unique\", keys, partial)",
    "ddl_table_info": "SELECT * FROM (VALUES (0, 'id', 'INT', 0, NULL, 1), (1, 'name', 'TEXT', 1, NULL, 0), (2, 'region', 'INT', 0, '4', 0)) AS t(cid, name, type, \"notnull\", dflt_value, pk)",
    "tx_rollback": f"SELECT * FROM ({_NATION}) WHERE region NOT IN (0, 1)",
    "tx_fresh_read": f"SELECT id, name, region, (SELECT count(*) FROM nation) AS before FROM ({_NATION}) WHERE region = 2",
    "maint_backup_restore": _NATION,
    "maint_vacuum": f"SELECT place, id, name FROM ({_NATION}) CROSS JOIN (VALUES ('here'), ('there')) AS p(place) WHERE region <> 0",
    "maint_analyze": "SELECT tbl, idx, (SELECT count(*) FROM nation WHERE n_regionkey <> 1)::VARCHAR AS stat FROM (VALUES ('nat', NULL), ('nat', 'by_region')) AS t(tbl, idx)",
    "maint_reap": "SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS reaped FROM nation WHERE n_nationkey % 2 = 1",
    "maint_integrity": "SELECT n_nationkey AS id, 'ok' AS checked, 'versioned' AS journal FROM nation",
    "maint_explain": "SELECT count(DISTINCT n_regionkey) AS n, true AS measured FROM nation",
    "api_parameters": f"SELECT id, name FROM ({_NATION}) WHERE region = 1 AND name >= 'C' OR id = 24",
    "api_cursor": f"SELECT id, name FROM ({_NATION}) WHERE region IN (0, 3)",
    "api_changes": "SELECT t::INT AS turn, CASE t WHEN 0 THEN (SELECT count(*) FROM nation) WHEN 1 THEN 2 WHEN 2 THEN (SELECT count(*) + 2 FROM nation WHERE n_regionkey = 1) ELSE 2 END::BIGINT AS changed, CASE t WHEN 0 THEN (SELECT max(n_nationkey) FROM nation) ELSE 71 END::BIGINT AS last FROM range(4) AS r(t)",
    "api_schema": "SELECT * FROM (VALUES ('nat', 'CREATE TABLE nat (id INT, name TEXT, region INT, PRIMARY KEY (id))'), ('small', 'CREATE TABLE small (id INT, v VARCHAR(5) NOT NULL DEFAULT ''x'', PRIMARY KEY (id))')) AS t(name, sql)",
    "fts_table": "SELECT (doc_id + 1)::INT AS id FROM documents WHERE contains(lower(concat_ws(' ', lang, text)), 'license')",
    "stream_sliding": "SELECT date_trunc('hour', ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS o(k) GROUP BY ALL",
    "stream_sessions": "WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_expiry": "SELECT event_id FROM events WHERE event_id % 2 <> 0",
    "notify_channel": "SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INT AS turn, r_name AS message FROM region",
}
