import pytest

from tessera import Database
from tessera.operators.dml import ConstraintError
from tessera.sources.store import ConflictError


@pytest.fixture
def clock():
    return [1000.0]


@pytest.fixture
def db(spark, tmp_path, clock):
    return Database(spark, str(tmp_path / "db"), clock=lambda: clock[0])


def rows(db, sql, *args):
    return [tuple(r) for r in db.sql(sql, list(args)).collect()]


def test_insert_defaults_and_constraints(db):
    db.sql("CREATE TABLE users (id INT PRIMARY KEY, name TEXT NOT NULL UNIQUE, age INT CHECK (age >= 18), city VARCHAR(5) DEFAULT 'X')")
    db.sql("INSERT INTO users (id, name, age) VALUES (1, 'O''Hara', 20), (2, 'NULL', NULL)")
    assert rows(db, "SELECT * FROM users ORDER BY id") == [(1, "O'Hara", 20, "X"), (2, "NULL", None, "X")]
    for bad in ("(3, NULL, 20, 'a')", "(3, 'c', 2, 'a')", "(3, 'NULL', 20, 'a')", "(1, 'c', 20, 'a')", "(3, 'c', 20, 'toolong')"):
        with pytest.raises(ConstraintError):
            db.sql(f"INSERT INTO users VALUES {bad}")
    assert rows(db, "SELECT count(*) FROM users WHERE name = ? AND age >= ?2", "O'Hara", 18) == [(1,)]


def test_upserts_and_returning(db):
    db.sql("CREATE TABLE stock (sku INT PRIMARY KEY, place TEXT, pieces INT DEFAULT 10)")
    db.sql("INSERT INTO stock (sku, place) VALUES (17, 'cellar'), (4, 'attic')")
    assert rows(db, "INSERT OR IGNORE INTO stock VALUES (17, 'yard', 1) RETURNING sku") == []
    assert rows(db, "INSERT OR REPLACE INTO stock VALUES (17, 'shed', 3) RETURNING place, pieces") == [("shed", 3)]
    db.sql("INSERT INTO stock VALUES (17, 'shelf', 5), (30, 'hall', 2) ON CONFLICT (sku) DO UPDATE SET pieces = pieces + excluded.pieces")
    assert rows(db, "SELECT * FROM stock ORDER BY sku") == [(4, "attic", 10), (17, "shed", 8), (30, "hall", 2)]
    db.sql("INSERT INTO stock VALUES (30, 'loft', 0) ON CONFLICT (sku) DO UPDATE SET place = place || '-it''s-' || excluded.place")
    assert rows(db, "SELECT place FROM stock WHERE sku = 30") == [("hall-it's-loft",)]
    assert rows(db, "UPDATE stock SET place = upper(place), pieces = 0 WHERE sku < 10 RETURNING *") == [(4, "ATTIC", 0)]
    assert rows(db, "DELETE FROM stock WHERE pieces > 5 RETURNING place") == [("shed",)]
    assert db.changes == 1


def test_keys_that_repeat_in_a_statement(db):
    db.sql("CREATE TABLE acc (id INT PRIMARY KEY, v TEXT, n INT)")
    db.sql("INSERT OR REPLACE INTO acc VALUES (1, 'a', 1), (1, 'b', 2)")
    db.sql("INSERT OR IGNORE INTO acc VALUES (2, 'c', 1), (2, 'd', 2)")
    db.sql("INSERT INTO acc VALUES (1, 'e', 10), (3, 'f', 20), (1, 'g', 30), (3, 'h', 40) ON CONFLICT (id) DO UPDATE SET v = v || excluded.v, n = n + excluded.n")
    assert rows(db, "SELECT * FROM acc ORDER BY id") == [(1, "beg", 42), (2, "c", 1), (3, "fh", 60)]


def test_readers_see_commits_and_subqueries_are_fresh(db, spark):
    db.sql("CREATE TABLE t (id INT); CREATE TABLE k (id INT)")
    other = Database(spark, db.store.root)
    db.sql("INSERT INTO t VALUES (1), (2)")
    assert rows(other, "SELECT count(*) FROM t") == [(2,)]
    other.sql("INSERT INTO k VALUES (2)")
    db.sql("DELETE FROM t WHERE id NOT IN (SELECT id FROM k)")
    assert rows(db, "SELECT id FROM t") == [(2,)]


def test_triggers_run_for_each_row(db):
    db.sql("CREATE TABLE src (id INT, v INT); CREATE TABLE c (id INT, n INT); INSERT INTO c VALUES (1, 0), (2, 100)")
    db.sql("CREATE TRIGGER tr AFTER INSERT ON src BEGIN UPDATE c SET n = n + NEW.v WHERE id = 1; UPDATE c SET n = n + 1 WHERE id = 2; END")
    db.sql("INSERT INTO src VALUES (1, 5), (2, 6), (3, 7)")
    assert rows(db, "SELECT * FROM c ORDER BY id") == [(1, 18), (2, 103)]
    with pytest.raises(ValueError, match="at most"):
        db.insert_rows("src", db.spark.range(200).selectExpr("CAST(id AS INT) + 10 AS id", "1 AS v"))
    assert rows(db, "SELECT count(*) FROM src") == [(3,)]


def test_dropped_columns_and_unique_indexes(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT, w INT CHECK (w > 0), x INT); INSERT INTO t VALUES (1, 'a', 5, 6), (2, 'A', 7, 8)")
    with pytest.raises(ValueError, match="check"):
        db.sql("ALTER TABLE t DROP COLUMN w")
    db.sql("ALTER TABLE t DROP COLUMN x; ALTER TABLE t ADD COLUMN x TEXT")
    assert rows(db, "SELECT id, x FROM t ORDER BY id") == [(1, None), (2, None)]
    with pytest.raises(ConstraintError):
        db.sql("CREATE UNIQUE INDEX u ON t (lower(v))")
    db.sql("CREATE UNIQUE INDEX u ON t (lower(v)) WHERE id > 1")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO t VALUES (3, 'a', 1, 'x')")
    db.sql("DROP INDEX u; INSERT INTO t VALUES (3, 'a', 1, 'x')")
    assert rows(db, "SELECT count(*) FROM t") == [(3,)]


def test_cascades(db):
    db.sql("CREATE TABLE parents (id INT, name TEXT); CREATE TABLE kids (id INT, pid INT REFERENCES parents(id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.sql("CREATE TABLE strict (id INT, pid INT REFERENCES parents(id))")
    db.sql("INSERT INTO parents VALUES (1, 'a'), (2, 'b'), (3, 'c'); INSERT INTO kids VALUES (10, 1), (11, 2); INSERT INTO strict VALUES (1, 3)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO kids VALUES (12, 9)")
    with pytest.raises(ConstraintError):
        db.sql("DELETE FROM parents WHERE id = 3")
    db.sql("UPDATE parents SET id = 5 WHERE id = 1; DELETE FROM parents WHERE id = 2")
    assert rows(db, "SELECT * FROM kids") == [(10, 5)]
    assert rows(db, "SELECT count(*) FROM parents") == [(2,)]


def test_expiry(db, clock):
    db.sql("CREATE TABLE cache (id INT, val TEXT) WITH TTL = 10")
    db.sql("INSERT INTO cache VALUES (1, 'a'); INSERT INTO cache VALUES (2, 'b') EXPIRES 100")
    clock[0] += 10
    assert rows(db, "SELECT count(*) FROM cache") == [(2,)]
    clock[0] += 1
    assert rows(db, "SELECT id FROM cache") == [(2,)]
    assert rows(db, "PRAGMA reap_expired(cache)") == [(1,)]


def test_history_and_triggers(db):
    db.sql("CREATE TABLE p (id INT, price DOUBLE) WITH HISTORY; CREATE TABLE log (id INT AUTOINCREMENT, old DOUBLE, new DOUBLE)")
    db.sql("CREATE TRIGGER tr AFTER UPDATE ON p BEGIN INSERT INTO log VALUES (0, OLD.price, NEW.price); END")
    db.sql("INSERT INTO p VALUES (1, 2.0); UPDATE p SET price = 3.0 WHERE id = 1; DELETE FROM p")
    assert rows(db, "SELECT history_action, id, price FROM _history_p ORDER BY history_id") == [("INSERT", 1, 2.0), ("UPDATE", 1, 3.0), ("DELETE", 1, 3.0)]
    assert rows(db, "SELECT id, old, new FROM log") == [(1, 2.0, 3.0)]
    db.sql("CREATE TABLE a (id INT AUTOINCREMENT); CREATE TRIGGER x AFTER INSERT ON a BEGIN INSERT INTO a VALUES (0); END")
    with pytest.raises(RecursionError):
        db.sql("INSERT INTO a VALUES (0)")
    assert rows(db, "SELECT count(*) FROM a") == [(0,)]


def test_transactions_and_conflicts(db, spark):
    db.sql("CREATE TABLE t (id INT, v TEXT)")
    db.sql("BEGIN; INSERT INTO t VALUES (1, 'a'); SAVEPOINT s; INSERT INTO t VALUES (2, 'b'); ROLLBACK TO s; COMMIT")
    assert rows(db, "SELECT id FROM t") == [(1,)]
    other = Database(spark, db.store.root)
    db.sql("BEGIN; DELETE FROM t")
    other.sql("INSERT INTO t VALUES (3, 'c')")
    with pytest.raises(ConflictError):
        db.sql("COMMIT")
    pinned = Database(spark, db.store.root, at=2)
    assert rows(pinned, "SELECT id FROM t") == [(1,)]
    with pytest.raises(PermissionError):
        pinned.sql("DELETE FROM t")


def test_schema_changes(db):
    db.sql("CREATE TABLE birds (id INT, kind TEXT, ring INT); INSERT INTO birds VALUES (6, 'wren', 88)")
    db.sql("ALTER TABLE birds RENAME TO flock; ALTER TABLE flock ADD COLUMN grams INT DEFAULT 9; ALTER TABLE flock DROP COLUMN ring")
    assert rows(db, "SELECT * FROM flock") == [(6, "wren", 9)]
    db.sql("CREATE VIEW quoted AS SELECT 'it''s' AS q FROM flock")
    assert rows(db, "SELECT q FROM quoted") == [("it's",)]
    db.sql("CREATE INDEX i ON flock (lower(kind)) WHERE id = 6; CREATE VIEW few AS SELECT * FROM flock WHERE kind = 'wren' OR id = 70")
    assert rows(db, "SELECT id FROM few WHERE grams < 3") == []
    assert [r[1] for r in rows(db, "PRAGMA table_info(flock)")] == ["id", "kind", "grams"]
    assert rows(db, "PRAGMA index_list(flock)") == [(0, "i", 0, "lower(kind)", 1)]
    db.sql("DROP VIEW few; DROP TABLE flock")
    assert rows(db, "PRAGMA tables") == []


def test_backup_and_restore(db, spark, tmp_path, clock):
    db.sql("CREATE TABLE e (id INT, val TEXT)")
    for i in (1, 2, 3):
        clock[0] = 1000.0 + 10 * i
        db.sql(f"INSERT INTO e VALUES ({i}, 'v')")
    db.sql(f"BACKUP DATABASE TO '{tmp_path}/b'")
    db.sql(f"RESTORE DATABASE FROM '{tmp_path}/b' UNTIL TIMESTAMP 1020 TO '{tmp_path}/r'")
    assert rows(Database(spark, f"{tmp_path}/r"), "SELECT count(*) FROM e") == [(2,)]
    with pytest.raises(FileExistsError):
        db.sql(f"RESTORE DATABASE FROM '{tmp_path}/b' TO '{tmp_path}/r'")
    with pytest.raises(ValueError):
        db.sql(f"RESTORE DATABASE FROM '{tmp_path}/b' UNTIL LSN 0 TO '{tmp_path}/r2'")
    db.sql("VACUUM")
    db.sql(f"VACUUM INTO '{tmp_path}/v'; ATTACH DATABASE '{tmp_path}/v' AS aux")
    assert rows(db, "SELECT count(*) FROM aux.e") == [(3,)]
    assert rows(db, "PRAGMA integrity_check") == [("ok",)]


def test_virtual_tables(db, tmp_path):
    (tmp_path / "f.csv").write_text('id,username,city\n1,"a, b",\n2,c,y\n')
    db.sql(f"CREATE VIRTUAL TABLE c USING csv('{tmp_path}/f.csv')")
    assert rows(db, "SELECT * FROM c ORDER BY id") == [(1, "a, b", None), (2, "c", "y")]
    db.sql("CREATE VIRTUAL TABLE docs USING fts5(title, body); INSERT INTO docs VALUES ('Doc 1', 'Engines are fast')")
    assert rows(db, "SELECT title FROM docs WHERE docs MATCH 'engines'") == [("Doc 1",)]


def test_only_touched_files_are_rewritten(db):
    db.sql("CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 1); INSERT INTO t VALUES (2, 2); INSERT INTO t VALUES (3, 3)")
    before = set(db.manifest["tables"]["t"]["files"])
    db.sql("UPDATE t SET v = 9 WHERE id = 2")
    assert len(before & set(db.manifest["tables"]["t"]["files"])) == 2
    assert rows(db, "EXPLAIN ANALYZE SELECT * FROM t")[-2][1] == "rows: 3"
