"""Every relational query against DuckDB, and the plans of some."""

import duckdb
import pytest

from tessera.plans import explain, queries
from tessera.session import TABLES, load
from tessera.streaming import changes, windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _same(rows, columns, order):
    return sorted(repr([tuple(r) if isinstance(r, list) else r for r in (row[columns.index(c)] for c in order)]) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    oracle = queries.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    result = duck.execute(oracle)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    kinds = dict(df.dtypes)
    wrong = {d[0]: (kinds[d[0]], str(d[1])) for d in result.description if kinds[d[0]] in types and str(d[1]) not in (types[kinds[d[0]]], "STRING", "NUMBER", "bool", "DATETIME")}
    assert not wrong
    assert _same(rows, df.columns, sorted(columns)) == _same(result.fetchall(), columns, sorted(columns))


@pytest.mark.parametrize(
    ("name", "has", "lacks"),
    [
        ("exists_subquery", ["LeftSemi"], ["CartesianProduct"]),
        ("not_exists_subquery", ["LeftAnti"], ["CartesianProduct"]),
        ("topk", ["TakeOrderedAndProject"], ["Exchange rangepartitioning"]),
        ("pk_seek", ["PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,42)]"], ["Exchange"]),
        ("flagship", ["Join", "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>"], ["CartesianProduct"]),
        ("knn_l2", ["TakeOrderedAndProject"], ["ArrowEvalPython", "BatchEvalPython"]),
    ],
)
def test_plan(spark, name, has, lacks):
    text = explain.text(queries.queries()[name](spark, SF))
    assert all(x in text for x in has) and not any(x in text for x in lacks)


def test_stream_windows(spark):
    events = windows.event_stream(spark, SF)
    assert events.isStreaming
    typed = events.withColumn("ts", events.ts.cast("timestamp"))
    total = load(spark, SF, "events").count()
    slid = windows.drain(windows.sliding(typed, "2 hours", "1 hour", "1 hour", ["event_type"]))
    assert slid.agg({"n": "sum"}).first()[0] == 2 * total
    assert windows.drain(windows.sessions(typed, "10 minutes", "1 hour", ["user_id"])).agg({"n": "sum"}).first()[0] == total


def test_change_feed_and_channel(spark, tmp_path):
    from tessera import Database

    db = Database(spark, str(tmp_path / "db"))
    db.sql("CREATE TABLE t (id INT, v TEXT) WITH HISTORY; INSERT INTO t VALUES (1, 'a'); UPDATE t SET v = 'b'")
    feed = windows.drain(changes.change_feed(db, "t"), "append")
    assert sorted((r.history_action, r.v) for r in feed.collect()) == [("INSERT", "a"), ("UPDATE", "b")]
    heard = []
    channel = changes.Channel(spark, str(tmp_path / "ch"), "news")
    channel.notify("one")
    channel.notify("two")
    channel.listen(heard.append, str(tmp_path / "cp")).awaitTermination()
    assert heard == ["one", "two"]
