"""A database: statements in the engine's dialect over versioned tables. Queries go to Spark; changes become new versions."""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions import register_functions
from tessera.operators import dml
from tessera.operators.dml import ConstraintError
from tessera.plans import explain
from tessera.plans.dialect import rewrite, rewrite_tokens
from tessera.plans.tokens import Token, closing, joined, literal, name, source, split_commas, split_statements, tokenize
from tessera.sources.csv import header, read_csv
from tessera.sources.store import EXPIRES, Store
from tessera.types import COLLATIONS, length_limit, spark_type

#: Triggers may set off triggers this deep; cascades that come back to a table end there.
MOST_DEPTH = 4
_CHANGES = "_tessera_changes"
#: Order of the rows of a statement, where its rows may meet each other.
_TURN = "_turn"
#: An UPDATE in a trigger is run row by row for up to so many changed rows.
MOST_ROWS = 100


def _words(tokens: list[Token], n: int) -> list[str]:
    return [t.upper for t in tokens[:n]]


def _find(tokens: list[Token], *words: str, start: int = 0) -> int:
    """The first place, outside brackets, of a run of words; -1 if there is none."""
    depth = 0
    for i in range(start, len(tokens)):
        if not depth and [t.upper for t in tokens[i : i + len(words)]] == list(words):
            return i
        depth += {"(": 1, ")": -1}.get(tokens[i].text, 0)
    return -1


class Database:
    """Tables under one root folder. ``at`` pins a version, which makes the database read-only.

    ``clock`` gives the epoch second that expiry and history use; tests inject their own.
    """

    def __init__(self, spark: SparkSession, root: str, *, at: int | None = None, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.store, self.clock, self.at = spark, Store(spark, root), clock, at
        self.manifest = self.store.manifest(at)
        self.staged: dict | None = None
        self.savepoints: list[tuple[str, dict]] = []
        self.attached: dict[str, Database] = {}
        self.changes = 0
        self.last_insert_rowid: int | None = None
        self.depth = 0
        self.listeners: dict[str, list[Callable[[str], None]]] = {}
        register_functions(spark)

    # Statements

    def sql(self, text: str, args: Sequence | None = None) -> DataFrame | None:
        """Run one or more statements and return the last one's rows, if it has any."""
        if text.lstrip().startswith("."):
            return self._dot(text.split())
        result = None
        for tokens in split_statements(text):
            result = self.run(tokens, list(args or []))
        return result

    def run(self, tokens: list[Token], args: list | None = None) -> DataFrame | None:
        self._refresh()
        tokens, args = self._bound(tokens, args or [])
        first = _words(tokens, 3) + ["", ""]
        simple = {
            "BEGIN": self._begin, "COMMIT": self._commit, "END": self._commit, "ROLLBACK": self._rollback, "SAVEPOINT": self._savepoint, "RELEASE": self._release,
            "INSERT": self._insert, "REPLACE": self._insert, "UPDATE": self._update, "DELETE": self._delete, "ALTER": self._alter, "DROP": self._drop, "ATTACH": self._attach, "DETACH": self._detach,
            "VACUUM": self._vacuum, "ANALYZE": self._analyze, "REINDEX": lambda t: None, "PRAGMA": self._pragma, "BACKUP": self._backup, "RESTORE": self._restore, "LISTEN": self._listen, "NOTIFY": self._notify, "EXPLAIN": self._explain,
        }
        if first[0] == "CREATE":
            kind = next((w for w in first[1:] if w in ("TABLE", "VIEW", "INDEX", "TRIGGER", "VIRTUAL")), "")
            return {"TABLE": self._create_table, "VIEW": self._create_view, "INDEX": self._create_index, "TRIGGER": self._create_trigger, "VIRTUAL": self._create_virtual}[kind](tokens)
        if first[0] in simple:
            return simple[first[0]](tokens)
        return self.query(tokens, args)

    def prepare(self, text: str) -> Statement:
        """A statement that is bound and stepped through row by row."""
        (tokens,) = split_statements(text)
        return Statement(self, tokens)

    def _dot(self, words: list[str]) -> DataFrame:
        """``.tables``, ``.schema [table]`` and ``.help`` as rows."""
        self._refresh()
        only = words[1].lower() if len(words) > 1 else None
        if words[0] == ".tables":
            return self.spark.createDataFrame([(t,) for t in sorted(self._tables())], "name string")
        if words[0] == ".schema":
            return self.spark.createDataFrame([(t, self._definition(t)) for t in sorted(self._tables()) if only in (None, t)], "name string, sql string")
        if words[0] == ".help":
            return self.spark.createDataFrame([(".tables", "names of all tables"), (".schema [table]", "their definitions"), (".help", "this list")], "command string, shows string")
        raise ValueError(f"no such command: {words[0]}")

    def _definition(self, table: str) -> str:
        meta = self._meta(table)
        parts = [" ".join(filter(None, [c["name"], c.get("declared") or c["type"], "NOT NULL" if c.get("not_null") else "", "UNIQUE" if c.get("unique") else "", f"DEFAULT {c['default']}" if c["default"] is not None else ""])) for c in meta["columns"]]
        parts += [f"PRIMARY KEY ({', '.join(meta['primary_key'])})"] if meta["primary_key"] else []
        parts += [f"UNIQUE ({', '.join(k)})" for k in meta.get("unique_sets", [])] + [f"CHECK ({x})" for x in meta["checks"]]
        parts += [f"FOREIGN KEY ({r['column']}) REFERENCES {r['parent']}" + (f" ({r['parent_column']})" if r["parent_column"] else "") + f" ON DELETE {r['on_delete']} ON UPDATE {r['on_update']}" for r in meta["references"]]
        return f"CREATE TABLE {table} ({', '.join(parts)})" + (" WITH HISTORY" if meta["history"] else "")

    @staticmethod
    def _bound(tokens: list[Token], args: list) -> tuple[list[Token], list]:
        """``?`` and ``?N`` become literals, so that they may stand anywhere, in changes as in queries."""
        out, turn = [], 0
        for t in tokens:
            if t.kind != "param":
                out.append(t)
                continue
            at = int(t.text[1:]) - 1 if len(t.text) > 1 else turn
            turn = max(turn, at + 1)
            value = args[at]
            if value is None:
                out.append(Token("word", "NULL"))
            elif isinstance(value, bool):
                out.append(Token("word", str(value).upper()))
            elif isinstance(value, int | float):
                out += [Token("sign", "("), Token("number", f"{value!r}{'D' if isinstance(value, float) else ''}"), Token("sign", ")")]
            elif isinstance(value, bytes):
                out.append(Token("binary", f"X'{value.hex()}'"))
            else:
                out.append(Token("string", "'" + str(value).replace("'", "''") + "'"))
        return out, []

    def query(self, tokens: list[Token], args: list | None = None) -> DataFrame:
        return self.spark.sql(rewrite_tokens(self._resolved(tokens)))

    def _resolved(self, tokens: list[Token]) -> list[Token]:
        """Register the tables and views that a statement names; ``alias.table`` becomes the view of the attached table."""
        out, i = [], 0
        while i < len(tokens):
            t = tokens[i]
            if t.kind in ("word", "quoted"):
                other = self.attached.get(name(t).lower())
                if other and i + 2 < len(tokens) and tokens[i + 1].text == "." and other._known(name(tokens[i + 2])):
                    view = f"{name(t)}__{name(tokens[i + 2])}".lower()
                    other.table(name(tokens[i + 2])).createOrReplaceTempView(view)
                    out.append(Token("word", view))
                    i += 3
                    continue
                if (not out or out[-1].text != ".") and self._known(name(t)):
                    self.table(name(t)).createOrReplaceTempView(name(t))
            out.append(t)
            i += 1
        return self._fts(out)

    def _fts(self, tokens: list[Token]) -> list[Token]:
        """``table MATCH 'q'`` on a text-search table searches all of its text columns."""
        out = list(tokens)
        for i, t in enumerate(tokens):
            if t.upper == "MATCH" and i and (table := self._tables().get(name(tokens[i - 1]).lower())) and table.get("fts"):
                cells = [Token("raw", "concat_ws(' ', " + ", ".join(f"`{c['name']}`" for c in table["columns"][1:]) + ")")]
                out[i - 1 : i] = cells
        return out

    # Tables

    def _refresh(self) -> None:
        """Each statement sees what other writers have committed, unless a version is pinned or a transaction is open."""
        if self.at is None and self.staged is None and (known := self.store.versions()) and known[-1] != self.manifest["version"]:
            self.manifest = self.store.manifest(known[-1])

    def _current(self) -> dict:
        return self.manifest if self.staged is None else self.staged

    def _tables(self) -> dict:
        return self._current()["tables"]

    def _known(self, table: str) -> bool:
        return table.lower() in self._tables() or table.lower() in self._current()["views"]

    def _meta(self, table: str) -> dict:
        try:
            return self._tables()[table.lower()]
        except KeyError:
            raise ValueError(f"no such table: {table}") from None

    def table(self, table: str) -> DataFrame:
        """The live rows of a table, or the rows of a view."""
        self._refresh()
        view = self._current()["views"].get(table.lower())
        if view:
            return self.sql(view)
        meta = self._meta(table)
        if meta.get("csv"):
            return read_csv(self.spark, meta["csv"])
        return self._live(meta).drop(EXPIRES)

    def _live(self, meta: dict, files: list[str] | None = None) -> DataFrame:
        return self.store.live(meta, self.clock(), files)

    def _change(self, change: Callable[[dict], None]) -> None:
        """Apply a change to the staged manifest, which is committed at once outside a transaction."""
        if self.at is not None:
            raise PermissionError("a pinned version can't be changed")
        own = self.staged is None
        if own:
            self.manifest = self.store.manifest()
            self.staged = copy.deepcopy(self.manifest)
        try:
            change(self.staged)
            if own:
                self.manifest = self.store.commit(self.staged, self.clock())
        finally:
            if own:
                self.staged = None

    def _statement(self, work: Callable[[], DataFrame | None]) -> DataFrame | None:
        """A statement with its cascades, history and triggers is one change: all of it or nothing."""
        result: list = [None]

        def change(staged: dict) -> None:
            before = copy.deepcopy(staged)
            try:
                result[0] = work()
            except Exception:
                staged.clear()
                staged.update(before)
                raise

        if self.depth:
            return work()
        self._change(change)
        return result[0]

    # Definitions

    def _column(self, tokens: list[Token], table: dict) -> None:
        column = {"name": name(tokens[0]), "declared": "TEXT", "type": "STRING", "default": None}
        i = 1
        declared = []
        stop = {"PRIMARY", "NOT", "NULL", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES", "COLLATE", "AUTOINCREMENT", "CONSTRAINT"}
        while i < len(tokens) and tokens[i].upper not in stop:
            declared.append(tokens[i])
            i += 1
        if declared:
            column["declared"] = "".join(t.text for t in declared) if len(declared) > 2 else " ".join(t.text for t in declared)
            column["type"] = spark_type(column["declared"])
            column["length"] = length_limit(column["declared"])
        while i < len(tokens):
            word = tokens[i].upper
            if word == "PRIMARY":
                table["primary_key"] = [column["name"]]
                i += 2
            elif word == "NOT":
                column["not_null"] = True
                i += 2
            elif word == "UNIQUE":
                column["unique"] = True
                i += 1
            elif word == "AUTOINCREMENT":
                column["autoincrement"] = True
                i += 1
            elif word == "DEFAULT":
                end = closing(tokens, i + 1) + 1 if tokens[i + 1].text == "(" else i + (3 if tokens[i + 1].text in "+-" else 2)
                column["default"] = source(tokens[i + 1 : end])
                i = end
            elif word == "CHECK":
                end = closing(tokens, i + 1)
                table["checks"].append(source(tokens[i + 2 : end]))
                i = end + 1
            elif word == "COLLATE":
                column["type"] = f"STRING COLLATE {COLLATIONS.get(tokens[i + 1].upper, tokens[i + 1].text)}"
                i += 2
            elif word == "REFERENCES":
                i = self._reference(tokens, i, [column["name"]], table)
            else:
                i += 1
        table["columns"].append(column)

    @staticmethod
    def _reference(tokens: list[Token], i: int, columns: list[str], table: dict) -> int:
        parent, target, actions = name(tokens[i + 1]), None, {"DELETE": "RESTRICT", "UPDATE": "RESTRICT"}
        i += 2
        if i < len(tokens) and tokens[i].text == "(":
            target = name(tokens[i + 1])
            i = closing(tokens, i) + 1
        while i + 2 < len(tokens) and tokens[i].upper == "ON":
            actions[tokens[i + 1].upper] = tokens[i + 2].upper
            i += 3
        table["references"].append({"column": columns[0], "parent": parent.lower(), "parent_column": target, "on_delete": actions["DELETE"], "on_update": actions["UPDATE"]})
        return i

    def _create_table(self, tokens: list[Token]) -> None:
        start = next(i for i, t in enumerate(tokens) if t.text == "(" or t.upper == "AS")
        table_name = name(tokens[start - 1]).lower()
        if table_name in self._tables():
            if _find(tokens, "IF", "NOT", "EXISTS") >= 0:
                return
            raise ValueError(f"table {table_name} already exists")
        if tokens[start].upper == "AS":
            raise ValueError("CREATE TABLE needs its columns")
        end = closing(tokens, start)
        table = {"columns": [], "primary_key": [], "checks": [], "references": [], "files": [], "ttl": None, "history": False}
        for part in split_commas(tokens[start + 1 : end]):
            if part[0].upper == "CONSTRAINT":
                part = part[2:]
            word = part[0].upper
            listed = [name(x[0]) for x in split_commas(part[part.index(Token("sign", "(")) + 1 : closing(part, part.index(Token("sign", "(")))])] if word in ("PRIMARY", "UNIQUE", "FOREIGN") else []
            if word == "PRIMARY":
                table["primary_key"] = listed
            elif word == "UNIQUE" and len(part) > 1 and part[1].text == "(":
                table.setdefault("unique_sets", []).append(listed)
            elif word == "FOREIGN":
                self._reference(part, _find(part, "REFERENCES"), listed, table)
            elif word == "CHECK":
                table["checks"].append(source(part[2 : closing(part, 1)]))
            else:
                self._column(part, table)
        first = table["columns"][0]
        if not table["primary_key"] and first["type"] in ("INT", "BIGINT", "SMALLINT", "TINYINT"):
            table["primary_key"] = [first["name"]]
        rest = tokens[end + 1 :]
        if (at := _find(rest, "TTL")) >= 0:
            table["ttl"] = float(rest[at + 2].text)
        table["history"] = _find(rest, "HISTORY") >= 0
        new = {table_name: table}
        if table["history"]:
            columns = [{"name": "history_id", "type": "BIGINT", "default": None}, {"name": "history_action", "type": "STRING", "default": None}, {"name": "history_time", "type": "DOUBLE", "default": None}]
            new[f"_history_{table_name}"] = {"columns": columns + [{"name": c["name"], "type": c["type"], "default": None} for c in table["columns"]], "primary_key": [], "checks": [], "references": [], "files": [], "ttl": None, "history": False}
        self._change(lambda m: m["tables"].update(new))

    def _create_virtual(self, tokens: list[Token]) -> None:
        at = _find(tokens, "USING")
        table_name, module = name(tokens[at - 1]).lower(), tokens[at + 1].upper
        args = split_commas(tokens[at + 3 : closing(tokens, at + 2)])
        plain = {"primary_key": [], "checks": [], "references": [], "files": [], "ttl": None, "history": False}
        if module == "CSV":
            path = literal(args[0][-1]) if args[0][-1].kind == "string" else "".join(t.text for t in args[0])
            first, *rest = header(self.spark, path)
            columns = [{"name": first, "type": "INT", "default": None}] + [{"name": c, "type": "STRING", "default": None} for c in rest]
            table = plain | {"columns": columns, "csv": path}
        elif module == "FTS5":
            columns = [{"name": "id", "type": "INT", "default": None}] + [{"name": name(a[0]), "type": "STRING", "default": None} for a in args if a[0].upper != "ID"]
            table = plain | {"columns": columns, "fts": True, "primary_key": ["id"]}
            table["columns"][0]["autoincrement"] = True
        else:
            raise ValueError(f"no such module: {module}")
        self._change(lambda m: m["tables"].update({table_name: table}))

    def _create_view(self, tokens: list[Token]) -> None:
        at = _find(tokens, "AS")
        self._change(lambda m: m["views"].update({name(tokens[at - 1]).lower(): source(tokens[at + 1 :])}))

    def _create_index(self, tokens: list[Token]) -> None:
        """Recorded for PRAGMA index_list. Reads prune by Parquet statistics instead; UNIQUE is enforced."""
        at = _find(tokens, "ON")
        table, start = name(tokens[at + 1]).lower(), at + 2
        self._meta(table)
        end = closing(tokens, start)
        keys = [joined(p) for p in split_commas(tokens[start + 1 : end])]
        where = joined(tokens[end + 2 :]) if len(tokens) > end + 1 else None
        index = {"table": table, "keys": keys, "where": where, "unique": "UNIQUE" in _words(tokens, 2)}

        def change(m: dict) -> None:
            if index["unique"]:
                rows = dml.index_keys(self._live(m["tables"][table]), keys, where)
                if not dml.repeated(rows, rows.columns).isEmpty():
                    raise ConstraintError(f"UNIQUE constraint failed: {table} has equal rows of {', '.join(keys)}")
            m["indexes"][name(tokens[at - 1]).lower()] = index

        self._change(change)

    def _create_trigger(self, tokens: list[Token]) -> None:
        begin = _find(tokens, "BEGIN")
        head = tokens[:begin]
        timing = next((t.upper for t in head if t.upper in ("BEFORE", "AFTER")), "AFTER")
        event = next(t.upper for t in head if t.upper in ("INSERT", "UPDATE", "DELETE"))
        table = name(head[_find(head, "ON") + 1]).lower()
        body: list[str] = [source(x) for x in split_statements(source(tokens[begin + 1 : -1]))]
        self._change(lambda m: m["triggers"].update({name(head[2 + 3 * (_find(head, "IF", "NOT", "EXISTS") == 2)]).lower(): {"table": table, "timing": timing, "event": event, "body": body}}))

    def _drop(self, tokens: list[Token]) -> None:
        kind, quiet, target = tokens[1].upper, _find(tokens, "IF", "EXISTS") >= 0, name(tokens[-1]).lower()
        place = {"TABLE": "tables", "VIEW": "views", "INDEX": "indexes", "TRIGGER": "triggers"}[kind]
        if target not in self._current()[place]:
            if quiet:
                return
            raise ValueError(f"no such {kind.lower()}: {target}")

        def change(m: dict) -> None:
            del m[place][target]
            if place == "tables":
                m["tables"].pop(f"_history_{target}", None)
                for other in ("indexes", "triggers"):
                    m[other] = {k: v for k, v in m[other].items() if v["table"] != target}

        self._change(change)
        if place in ("tables", "views"):
            self.spark.catalog.dropTempView(target)

    def _alter(self, tokens: list[Token]) -> None:
        table, action = name(tokens[2]).lower(), tokens[3].upper
        meta = self._meta(table)
        rest = tokens[5:] if len(tokens) > 4 and tokens[4].upper in ("COLUMN", "TO") else tokens[4:]
        if action == "RENAME":
            new = name(rest[0]).lower()

            def change(m: dict) -> None:
                m["tables"][new] = m["tables"].pop(table)
                for kind in ("indexes", "triggers"):
                    for x in m[kind].values():
                        x["table"] = new if x["table"] == table else x["table"]
                for other in m["tables"].values():
                    for r in other["references"]:
                        r["parent"] = new if r["parent"] == table else r["parent"]

        elif action == "ADD":
            added = copy.deepcopy(meta)
            self._column(rest, added)
            column = added["columns"][-1]

            def change(m: dict) -> None:
                if meta["files"] and (column["default"] is not None or column["name"].lower() in meta.get("gone", [])):
                    # Without the rewrite, files would show the values of a dropped column of that name.
                    value = F.lit(None) if column["default"] is None else F.expr(rewrite(column["default"]))
                    rows = self.store.read(meta).withColumn(column["name"], value.cast(column["type"]))
                    added["files"] = self.store.write(table, rows.select(*[c["name"] for c in added["columns"]], EXPIRES))
                m["tables"][table] = added

        else:
            gone = name(rest[0]).lower()

            if gone not in [c["name"].lower() for c in meta["columns"]]:
                raise ValueError(f"no such column: {table}.{gone}")
            if user := self._user_of(table, gone):
                raise ValueError(f"{gone} is used by {user}")

            def change(m: dict) -> None:
                # Files keep the dropped column; the schema that they are read with no longer asks for it.
                m["tables"][table]["columns"] = [c for c in meta["columns"] if c["name"].lower() != gone]
                m["tables"][table]["gone"] = sorted({*meta.get("gone", []), gone})

        self._change(change)
        self.spark.catalog.dropTempView(table)

    def _user_of(self, table: str, column: str) -> str | None:
        """What needs a column: a key, a check, a reference or an index."""
        meta = self._meta(table)
        names = lambda text: {name(t).lower() for t in tokenize(text)}
        if column in [k.lower() for keys in [meta["primary_key"], *meta.get("unique_sets", [])] for k in keys]:
            return "a key"
        if any(column in names(x) for x in meta["checks"]):
            return "a check"
        if any(r["column"].lower() == column for r in meta["references"]) or any(c.lower() == column for _, _, c in self._children(table)):
            return "a reference"
        return next((f"index {i}" for i, x in self._current()["indexes"].items() if x["table"] == table and any(column in names(k) for k in [*x["keys"], x["where"] or ""])), None)

    # Changes

    def _returning(self, tokens: list[Token]) -> tuple[list[Token], list[Token] | None]:
        at = _find(tokens, "RETURNING")
        return (tokens, None) if at < 0 else (tokens[:at], tokens[at + 1 :])

    def _returned(self, rows: DataFrame, items: list[Token] | None) -> DataFrame | None:
        if items is None:
            return None
        rows.createOrReplaceTempView("_tessera_returned")
        return self.spark.sql(f"SELECT {rewrite_tokens(items)} FROM _tessera_returned")

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        """Rows written once, so that what is checked is what is stored, logged and returned."""
        files = self.store.write(label, df)
        return self.spark.read.schema(df.schema).parquet(*[f"{self.store.root}/{f}" for f in files]) if files else df.limit(0)

    def _insert(self, tokens: list[Token]) -> DataFrame | None:
        tokens, items = self._returning(tokens)
        on = "REPLACE" if tokens[0].upper == "REPLACE" else None
        if tokens[1].upper == "OR":
            on = tokens[2].upper
        sets: dict[str, str] | None = None
        into = _find(tokens, "INTO")
        if (at := _find(tokens, "ON", "CONFLICT")) >= 0:
            do = _find(tokens, "DO", start=at)
            on = "IGNORE" if tokens[do + 1].upper == "NOTHING" else "UPDATE"
            if on == "UPDATE":
                sets = self._sets(tokens[do + 3 :])
            tokens = tokens[:at]
        ttl = None
        if (at := _find(tokens, "EXPIRES")) >= 0:
            ttl = float(tokens[at + 1].text)
            tokens = tokens[:at]
        elif (at := _find(tokens, "WITH", "TTL")) >= 0:
            ttl = float(tokens[at + 3].text)
            tokens = tokens[:at]
        if len(tokens) > into + 2 and tokens[into + 2].text == "." and name(tokens[into + 1]).lower() in self.attached:
            raise ValueError("open the attached database to change it")
        table = name(tokens[into + 1]).lower()
        meta = self._meta(table)
        i, columns = into + 2, [c["name"] for c in meta["columns"]]
        if tokens[i].text == "(":
            end = closing(tokens, i)
            given = [name(p[0]) for p in split_commas(tokens[i + 1 : end])]
            known = {c.lower(): c for c in columns}
            columns, i = [known[g.lower()] for g in given], end + 1
        source = tokens[i:]
        if source[0].upper == "VALUES":
            texts = [[rewrite_tokens(v) for v in split_commas(p[1:-1])] for p in split_commas(source[1:])]
            if meta.get("fts") and len(texts[0]) == len(columns) - 1:
                columns = columns[1:]
            if any(len(r) != len(columns) for r in texts):
                raise ValueError(f"table {table} has {len(columns)} columns here")
            types = {c["name"]: c["type"] for c in meta["columns"]}
            cells = lambda r: ", ".join(f"{self._cell(v, types[c])} AS `{c}`" for c, v in zip(columns, r, strict=True))
            sql = " UNION ALL ".join(f"SELECT {cells(r)}" for r in texts)
            rows = lambda: self.spark.sql(sql)
        else:
            rows = lambda: self.query(source).toDF(*columns)
        return self._statement(lambda: self._returned(self.insert(table, rows(), on=on, sets=sets, ttl=ttl), items))

    @staticmethod
    def _cell(text: str, kind: str) -> str:
        if kind.startswith("ARRAY") and text.startswith("'"):
            return f"CAST(from_json({text}, 'array<double>') AS {kind})"
        if kind == "BINARY" and text.startswith("'"):
            return f"CAST({text} AS BINARY)"
        return f"CAST({text} AS {kind.split(' COLLATE')[0]})"

    def _sets(self, tokens: list[Token]) -> dict[str, str]:
        return {name(p[0]): source(p[2:]) for p in split_commas(tokens)}

    def insert(self, table: str, df: DataFrame, *, on: str | None = None, sets: dict[str, str] | None = None, ttl: float | None = None) -> DataFrame:
        """Add rows, a DataFrame with some or all of the table's columns, and return the rows as stored."""
        meta = self._meta(table)
        ttl = meta["ttl"] if ttl is None else ttl
        given = {c.lower() for c in df.columns}
        existing = self._live(meta)
        columns = []
        for c in meta["columns"]:
            if c["name"].lower() in given:
                columns.append(F.col(f"`{c['name']}`").cast(c["type"]).alias(c["name"]))
            else:
                columns.append((F.expr(rewrite(c["default"])) if c["default"] is not None else F.lit(None)).cast(c["type"]).alias(c["name"]))
        new = df.select(*columns, F.lit(None if ttl is None else int(self.clock() + ttl)).cast("long").alias(EXPIRES))
        if on:
            new = new.withColumn(_TURN, F.monotonically_increasing_id())
        for c in meta["columns"]:
            if c.get("autoincrement"):
                top = existing.agg(F.coalesce(F.max(c["name"]), F.lit(0)).alias("m")).first()["m"]
                key = F.col(c["name"])
                missing = key.isNull() | (key == 0)
                filled = dml.numbered(self._kept(new.filter(missing).withColumn("_mid", F.monotonically_increasing_id()), f"{table}-new"), "_mid", "_n")
                filled = filled.withColumn(c["name"], (F.lit(top) + F.col("_n")).cast(c["type"])).select(*new.columns)
                new = new.filter(~missing).union(filled)
        new = self._kept(new, f"{table}-new")
        changed = new.drop(EXPIRES, _TURN)
        self._fire(table, "BEFORE", "INSERT", new=changed)
        dml.check_rows(changed, meta, table)
        self._parents(meta, table, changed)
        keys = meta["primary_key"]
        if on and keys:
            if on == "IGNORE":
                new = self._kept(dml.without_conflicts(dml.one_of_each(new, keys, _TURN, last=False), existing, keys), f"{table}-new")
            elif on in ("REPLACE", "UPDATE"):
                again = not dml.repeated(new, keys).isEmpty()
                if on == "REPLACE" or not again:
                    new = self._kept(dml.one_of_each(new, keys, _TURN, last=True), f"{table}-new") if again else new.drop(_TURN)
                return self._merge(table, meta, new, None if on == "REPLACE" else sets)
        new, changed = new.drop(_TURN), new.drop(EXPIRES, _TURN)
        self._unique(changed, existing, meta, table)
        self._tables()[table]["files"] = meta["files"] + self.store.write(table, new)
        self._count(meta, changed)
        self._after(table, "INSERT", new=changed)
        return changed

    def _count(self, meta: dict, rows: DataFrame) -> None:
        """``changes`` and, for a table with a whole-number key, ``last_insert_rowid`` after an insert that isn't a trigger's."""
        key = meta["primary_key"][0] if len(meta["primary_key"]) == 1 else None
        number = key and next(c["type"] in ("INT", "BIGINT", "SMALLINT", "TINYINT") for c in meta["columns"] if c["name"] == key)
        found = rows.agg(F.count("*").alias("n"), (F.max(key) if number else F.lit(None).cast("long")).alias("last")).first()
        if not self.depth:
            self.changes = found["n"]
            self.last_insert_rowid = found["last"] if found["last"] is not None else self.last_insert_rowid

    def insert_rows(self, table: str, df: DataFrame, **how) -> None:
        """Add the rows of any DataFrame as one statement: the way in for bulk loads."""
        self._statement(lambda: self.insert(table, df, **how))

    def _unique(self, rows: DataFrame, existing: DataFrame, meta: dict, table: str) -> None:
        dml.check_unique(rows, existing, meta, table)
        for keys in meta.get("unique_sets", []):
            dml.check_unique(rows, existing, {"primary_key": keys, "columns": []}, table)
        for x in self._current()["indexes"].values():
            if x["table"] == table and x["unique"]:
                new, old = (dml.index_keys(df, x["keys"], x["where"]) for df in (rows, existing))
                dml.check_unique(new, old, {"primary_key": new.columns, "columns": []}, table)

    def _merge(self, table: str, meta: dict, new: DataFrame, sets: dict[str, str] | None) -> DataFrame:
        """Upsert by primary key: only files that hold one of the keys are rewritten."""
        keys = meta["primary_key"]
        wanted = new.select(*keys).distinct()
        hit = self.store.touched(self.store.placed(meta).join(wanted, keys, "left_semi"))
        part = self._live(meta, hit)
        types = {c["name"].lower(): c["type"] for c in meta["columns"]}
        exprs = None if sets is None else {k: f"CAST({self._of_old(v, types)} AS {types[k.lower()]})" for k, v in sets.items()}
        if _TURN in new.columns:
            merged = dml.folded(part, new, keys, exprs, _TURN)
        else:
            merged = dml.upsert(part, new, keys, exprs and {k: F.expr(v) for k, v in exprs.items()})
        files = self.store.write(table, merged)
        rest = [f for f in meta["files"] if f not in set(hit)]
        stored = self.store.read(meta, files)
        after = stored.join(wanted, keys, "left_semi").drop(EXPIRES)
        self._count(meta, after)
        dml.check_rows(after, meta, table)
        others = self._live(meta, rest)
        self._unique(after, others.union(stored.join(wanted, keys, "left_anti")).select(*others.columns), meta | {"primary_key": []}, table)
        self._tables()[table]["files"] = rest + files
        before = part.drop(EXPIRES).join(wanted, keys, "left_semi")
        self._after(table, "UPDATE" if sets is not None else "INSERT", old=before, new=after)
        return after

    @staticmethod
    def _of_old(expression: str, columns: dict) -> str:
        """An expression in which bare column names mean the existing row."""
        tokens = tokenize(expression)
        bare = lambda i, t: t.kind in ("word", "quoted") and name(t).lower() in columns and (not i or tokens[i - 1].text != ".") and (i + 1 == len(tokens) or tokens[i + 1].text not in "(.")
        return rewrite_tokens([Token("raw", f"old.`{name(t)}`") if bare(i, t) else t for i, t in enumerate(tokens)])

    def _parents(self, meta: dict, table: str, rows: DataFrame, only: set[str] | None = None) -> None:
        for r in meta["references"]:
            if only is None or r["column"] in only:
                parent = self._meta(r["parent"])
                column = r["parent_column"] or parent["primary_key"][0]
                live = self._live(parent).select(column)
                if r["parent"] == table:
                    live = live.union(rows.select(column))
                dml.check_parents(rows, r["column"], live, column, f"FOREIGN KEY constraint failed: {table}.{r['column']}")

    def _children(self, table: str) -> list[tuple[str, dict, str]]:
        own = self._meta(table)
        return [(child, r, r["parent_column"] or own["primary_key"][0]) for child, m in self._tables().items() for r in m["references"] if r["parent"] == table]

    def _split(self, tokens: list[Token], start: int) -> tuple[list[Token], str]:
        at = _find(tokens, "WHERE", start=start)
        condition = "true" if at < 0 else rewrite_tokens(self._resolved(tokens[at + 1 :]))
        return tokens if at < 0 else tokens[:at], condition

    def _update(self, tokens: list[Token]) -> DataFrame | None:
        tokens, items = self._returning(tokens)
        table = name(tokens[1]).lower()

        def work() -> DataFrame | None:
            head, condition = self._split(tokens, 3)
            sets = {name(p[0]): rewrite_tokens(self._resolved(p[2:])) for p in split_commas(head[3:])}
            return self._returned(self.update(table, sets, condition), items)

        return self._statement(work)

    def _rows(self, table: str, meta: dict, condition: str) -> tuple[list[str], DataFrame]:
        """The files that hold matching live rows, and those files' live rows with ``_hit``."""
        if not meta["files"]:
            return [], self._live(meta).withColumn("_hit", F.lit(False))
        self.table(table).createOrReplaceTempView(table)
        placed = self.store.placed(meta).filter(F.col(EXPIRES).isNull() | (F.col(EXPIRES) >= F.lit(self.clock())))
        hit = self.store.touched(placed.alias(table).filter(condition))
        rows = self._live(meta, hit).alias(table)
        return hit, rows.withColumn("_hit", F.coalesce(F.expr(condition), F.lit(False))) if "select" not in condition.lower() else self._hits(rows, condition)

    @staticmethod
    def _hits(rows: DataFrame, condition: str) -> DataFrame:
        """Subqueries are allowed in a filter only; the rest is what the filter leaves."""
        marked = rows.filter(condition).withColumn("_hit", F.lit(True))
        return marked.union(rows.filter(f"NOT coalesce(({condition}), false)").withColumn("_hit", F.lit(False)))

    def update(self, table: str, sets: dict[str, str], condition: str = "true") -> DataFrame:
        """Change the rows that match and return them as they are then. Only files with such rows are rewritten."""
        meta = self._meta(table)
        types = {c["name"].lower(): c for c in meta["columns"]}
        sets = {types[k.lower()]["name"]: v for k, v in sets.items()}
        hit, rows = self._rows(table, meta, condition)
        names = [c["name"] for c in meta["columns"]]
        changed = lambda c: F.expr(sets[c]).cast(types[c.lower()]["type"])
        same = [F.col(f"`{c}`").alias(f"_new_{c}") for c in names]
        if any("select" in v.lower() for v in sets.values()):
            # A correlated subquery has to stand alone in its projection, over rows that are no union.
            rows = self._kept(rows.select(*names, EXPIRES, "_hit"), f"{table}-upd")
            stays = rows.filter("NOT _hit").select(*names, EXPIRES, "_hit", *same)
            moves = rows.filter("_hit").alias(table).select(*names, EXPIRES, "_hit", *[changed(c).alias(f"_new_{c}") if c in sets else x for c, x in zip(names, same, strict=True)])
            rows = stays.union(moves)
        else:
            rows = rows.select(*names, EXPIRES, "_hit", *[F.when(F.col("_hit"), changed(c)).otherwise(F.col(f"`{c}`")).alias(f"_new_{c}") if c in sets else x for c, x in zip(names, same, strict=True)])
        both = self._kept(rows, f"{table}-upd")
        old = both.filter("_hit").select(*names)
        new = both.filter("_hit").select(*[F.col(f"`_new_{c}`").alias(c) for c in names])
        self.changes = new.count()
        if not self.changes:
            return new
        changes = both.filter("_hit").select(F.struct(*names).alias("OLD"), F.struct(*[F.col(f"`_new_{c}`").alias(c) for c in names]).alias("NEW"))
        self._fire(table, "BEFORE", "UPDATE", changes=changes)
        dml.check_rows(new, meta, table)
        self._parents(meta, table, new, set(sets))
        rest = [f for f in meta["files"] if f not in set(hit)]
        untouched = self._live(meta, rest).drop(EXPIRES).union(both.filter("NOT _hit").select(*names))
        self._unique(new, untouched, meta, table)
        stored = both.select(*[F.col(f"`_new_{c}`").alias(c) for c in names], EXPIRES)
        self._tables()[table]["files"] = rest + self.store.write(table, stored)
        for child, r, column in self._children(table):
            if column in sets:
                moved = both.filter(f"_hit AND `{column}` IS DISTINCT FROM `_new_{column}`").select(F.col(f"`{column}`").alias("_from"), F.col(f"`_new_{column}`").alias("_to"))
                self._follow(child, r, moved, table)
        self._after(table, "UPDATE", changes=changes, old=old, new=new)
        return new

    def _follow(self, child: str, r: dict, moved: DataFrame, parent: str) -> None:
        """Children of changed keys: cascade, or refuse."""
        rows = self._live(self._meta(child))
        hit = rows.join(moved, rows[r["column"]] == moved["_from"], "left_semi")
        if hit.isEmpty():
            return
        if r["on_update"] != "CASCADE":
            raise ConstraintError(f"FOREIGN KEY constraint failed: {parent} is referenced by {child}")
        moved.createOrReplaceTempView("_tessera_moved")
        column = r["column"]
        self._deeper(lambda: self.update(child, {column: f"(SELECT max(_to) FROM _tessera_moved WHERE _from = {child}.`{column}`)"}, f"`{column}` IN (SELECT _from FROM _tessera_moved)"))

    def _delete(self, tokens: list[Token]) -> DataFrame | None:
        tokens, items = self._returning(tokens)
        table = name(tokens[2]).lower()
        return self._statement(lambda: self._returned(self.delete(table, self._split(tokens, 2)[1]), items))

    def delete(self, table: str, condition: str = "true") -> DataFrame:
        """Drop the rows that match and return them. Only files with such rows are rewritten."""
        meta = self._meta(table)
        hit, rows = self._rows(table, meta, condition)
        both = self._kept(rows, f"{table}-del")
        gone = both.filter("_hit").drop("_hit", EXPIRES)
        self.changes = gone.count()
        if not self.changes:
            return gone
        self._fire(table, "BEFORE", "DELETE", old=gone)
        files = [f for f in meta["files"] if f not in set(hit)]
        left = both.filter("NOT _hit").drop("_hit")
        self._tables()[table]["files"] = files + ([] if left.isEmpty() else self.store.write(table, left))
        for child, r, column in self._children(table):
            live = self._live(self._meta(child))
            keys = gone.select(F.col(column).alias("_gone")).distinct()
            if live.join(keys, live[r["column"]] == keys["_gone"], "left_semi").isEmpty():
                continue
            if r["on_delete"] != "CASCADE":
                raise ConstraintError(f"FOREIGN KEY constraint failed: {table} is referenced by {child}")
            view = f"_tessera_gone_{self.depth}"
            keys.createOrReplaceTempView(view)
            child_column = r["column"]
            self._deeper(lambda child=child, c=child_column, view=view: self.delete(child, f"`{c}` IN (SELECT _gone FROM {view})"))
        self._after(table, "DELETE", old=gone)
        return gone

    # History and triggers

    def _deeper(self, work: Callable[[], object]) -> None:
        if self.depth >= MOST_DEPTH:
            raise RecursionError("triggers and cascades go too deep")
        self.depth += 1
        try:
            work()
        finally:
            self.depth -= 1

    def _after(self, table: str, event: str, *, old: DataFrame | None = None, new: DataFrame | None = None, changes: DataFrame | None = None) -> None:
        if self._meta(table)["history"]:
            log = self._meta(f"_history_{table}")
            top = self.store.read(log).agg(F.coalesce(F.max("history_id"), F.lit(0)).alias("m")).first()["m"]
            rows = old if event == "DELETE" else new
            names = rows.columns
            rows = dml.numbered(self._kept(rows.withColumn("_mid", F.monotonically_increasing_id()), f"{table}-log"), "_mid", "_n")
            numbered = rows.select((F.lit(top) + F.col("_n")).cast("long").alias("history_id"), F.lit(event).alias("history_action"), F.lit(float(self.clock())).alias("history_time"), *[F.col(f"`{c}`") for c in names], F.lit(None).cast("long").alias(EXPIRES))
            log["files"] = log["files"] + self.store.write(f"_history_{table}", numbered)
        self._fire(table, "AFTER", event, old=old, new=new, changes=changes)

    def _fire(self, table: str, timing: str, event: str, *, old: DataFrame | None = None, new: DataFrame | None = None, changes: DataFrame | None = None) -> None:
        """Run a table's triggers for all changed rows, which have the fields OLD and NEW."""
        fired = [t for t in self._current()["triggers"].values() if (t["table"], t["timing"], t["event"]) == (table, timing, event)]
        if not fired:
            return
        if changes is None:
            sides = {"NEW": new, "OLD": old if new is None else None}
            side, rows = next((k, v) for k, v in sides.items() if v is not None)
            changes = rows.select(F.struct("*").alias(side))
        changes = self._kept(changes, f"{table}-fired")
        for trigger in fired:
            body = [tokens for statement in trigger["body"] for tokens in split_statements(statement)]
            rows = changes.limit(MOST_ROWS + 1).collect() if any(tokens[0].upper == "UPDATE" for tokens in body) else []
            if len(rows) > MOST_ROWS:
                raise ValueError(f"a trigger with an UPDATE takes at most {MOST_ROWS} changed rows in a statement; this one has more")
            # Inserts and deletes of all rows at once are the same as row by row; updates may meet their own results.
            for row in rows:
                for tokens in body:
                    self._deeper(lambda tokens=tokens, row=row: self.run(*self._of_row(tokens, row)))
            for tokens in body if not rows else []:
                changes.createOrReplaceTempView(_CHANGES)
                self._deeper(lambda tokens=tokens: self.run(self._set_based(tokens)))

    @staticmethod
    def _of_row(tokens: list[Token], row: Row) -> tuple[list[Token], list]:
        """A trigger's statement for one changed row: NEW.c and OLD.c become its values."""
        out, args, i = [], [], 0
        while i < len(tokens):
            if tokens[i].upper in ("NEW", "OLD") and i + 2 < len(tokens) and tokens[i + 1].text == ".":
                values = {k.lower(): v for k, v in row[tokens[i].upper].asDict().items()}
                args.append(values[name(tokens[i + 2]).lower()])
                out.append(Token("param", f"?{len(args)}"))
                i += 3
            else:
                out.append(tokens[i])
                i += 1
        return out, args

    @staticmethod
    def _set_based(tokens: list[Token]) -> list[Token]:
        """A trigger's statement over all changed rows at once."""
        bound = any(t.upper in ("NEW", "OLD") for t in tokens)
        source = [Token("word", "FROM"), Token("word", _CHANGES)]
        if tokens[0].upper == "INSERT" and (at := _find(tokens, "VALUES")) >= 0:
            return [*tokens[:at], Token("word", "SELECT"), *tokens[at + 2 : -1], *source]
        if not bound or (at := _find(tokens, "WHERE")) < 0 or tokens[0].upper != "DELETE":
            return tokens
        left, right = [Token("sign", "(")], [Token("sign", ")")]
        exists = [Token("word", "EXISTS"), *left, Token("word", "SELECT"), Token("number", "1"), *source, *tokens[at:], *right]
        head = tokens[:at]
        return [*head, Token("word", "WHERE"), *exists]

    # Transactions

    def _begin(self, tokens: list[Token]) -> None:
        if self.staged is not None:
            raise RuntimeError("a transaction is open already")
        self.manifest = self.store.manifest()
        self.staged = copy.deepcopy(self.manifest)
        self.savepoints = []

    def _commit(self, tokens: list[Token]) -> None:
        if self.staged is None:
            raise RuntimeError("no transaction is open")
        staged, self.staged, self.savepoints = self.staged, None, []
        self.manifest = self.store.commit(staged, self.clock())

    def _rollback(self, tokens: list[Token]) -> None:
        if _find(tokens, "TO") >= 0:
            target = name(tokens[-1]).lower()
            at = max(i for i, (n, _) in enumerate(self.savepoints) if n == target)
            self.savepoints = self.savepoints[: at + 1]
            self.staged = copy.deepcopy(self.savepoints[at][1])
            return
        if self.staged is None:
            raise RuntimeError("no transaction is open")
        self.staged, self.savepoints = None, []

    def _savepoint(self, tokens: list[Token]) -> None:
        if self.staged is None:
            self._begin(tokens)
        self.savepoints.append((name(tokens[-1]).lower(), copy.deepcopy(self.staged)))

    def _release(self, tokens: list[Token]) -> None:
        target = name(tokens[-1]).lower()
        at = max(i for i, (n, _) in enumerate(self.savepoints) if n == target)
        self.savepoints = self.savepoints[:at]

    # Maintenance

    def _attach(self, tokens: list[Token]) -> None:
        path = next(literal(t) for t in tokens if t.kind == "string")
        self.attached[name(tokens[-1]).lower()] = Database(self.spark, path, clock=self.clock)

    def _detach(self, tokens: list[Token]) -> None:
        del self.attached[name(tokens[-1]).lower()]

    def _vacuum(self, tokens: list[Token]) -> None:
        """Live rows in fresh files, here or in a new database of their own."""
        target = next((literal(t) for t in tokens if t.kind == "string"), None)
        store = self.store if target is None else Store(self.spark, target)

        def compacted(m: dict) -> None:
            for table, meta in m["tables"].items():
                if not meta.get("csv"):
                    meta["files"] = store.write(table, self._live(meta)) if meta["files"] else []

        if target is None:
            self._change(compacted)
        else:
            if store.versions():
                raise FileExistsError(target)
            copied = copy.deepcopy(self._current()) | {"version": 0}
            compacted(copied)
            store.commit(copied, self.clock())

    def _analyze(self, tokens: list[Token]) -> DataFrame:
        """Live rows per table, kept as the table sqlite_stat1 (tbl, idx, stat)."""
        counts = [(t, None, str(self.table(t).count())) for t in sorted(self._tables()) if t != "sqlite_stat1"]
        counts += [(x["table"], i, str(self.table(x["table"]).count())) for i, x in sorted(self._current()["indexes"].items())]
        df = self.spark.createDataFrame(counts, "tbl string, idx string, stat string")
        plain = {"primary_key": [], "checks": [], "references": [], "ttl": None, "history": False}
        columns = [{"name": c, "type": "STRING", "default": None} for c in df.columns]
        files = self.store.write("sqlite_stat1", df.withColumn(EXPIRES, F.lit(None).cast("long")))
        self._change(lambda m: m["tables"].update({"sqlite_stat1": plain | {"columns": columns, "files": files}}))
        return self.table("sqlite_stat1")

    def _pragma(self, tokens: list[Token]) -> DataFrame | None:
        what = tokens[1].upper
        arg = next((name(t) if t.kind != "string" else literal(t) for t in tokens[3:] if t.kind in ("word", "quoted", "string")), None)
        if what == "TABLE_INFO":
            meta = self._meta(arg)
            rows = [(i, c["name"], c.get("declared") or c["type"], int(bool(c.get("not_null"))), c["default"], int(c["name"] in meta["primary_key"])) for i, c in enumerate(meta["columns"])]
            return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")
        if what == "INDEX_LIST":
            rows = [(i, n, int(x["unique"]), ", ".join(x["keys"]), int(x["where"] is not None)) for i, (n, x) in enumerate(sorted(self._current()["indexes"].items())) if arg is None or x["table"] == arg.lower()]
            return self.spark.createDataFrame(rows, "seq int, name string, unique int, keys string, partial int")
        if what in ("TABLE_LIST", "TABLES"):
            return self.spark.createDataFrame([(t,) for t in sorted(self._tables())], "name string")
        if what == "REAP_EXPIRED":
            return self._reap(arg)
        if what == "VACUUM_MVCC":
            return self.spark.createDataFrame([(self.store.forget(),)], "files long")
        if what == "INTEGRITY_CHECK":
            lost = [f for t in self._tables().values() for f in t["files"] if not self.store.files.exists(f"{self.store.root}/{f}")]
            return self.spark.createDataFrame([(f"missing file {f}",) for f in lost] or [("ok",)], "integrity_check string")
        if what in ("JOURNAL_MODE", "AUTO_VACUUM", "WAL_CHECKPOINT"):
            return self.spark.createDataFrame([("versioned",)], f"{what.lower()} string")
        raise ValueError(f"no such pragma: {tokens[1].text}")

    def _reap(self, only: str | None) -> DataFrame:
        gone = 0

        def change(m: dict) -> None:
            nonlocal gone
            for table, meta in m["tables"].items():
                if (only is None or table == only.lower()) and meta["files"]:
                    dead = self.store.placed(meta).filter(F.col(EXPIRES) < F.lit(self.clock()))
                    gone += dead.count()
                    hit = self.store.touched(dead)
                    if hit:
                        meta["files"] = [f for f in meta["files"] if f not in set(hit)] + self.store.write(table, self._live(meta, hit))

        self._change(change)
        return self.spark.createDataFrame([(gone,)], "reaped long")

    def _backup(self, tokens: list[Token]) -> None:
        self.store.backup(literal(tokens[-1]))

    def _restore(self, tokens: list[Token]) -> None:
        source = next(literal(t) for t in tokens if t.kind == "string")
        target = literal(tokens[-1]) if _find(tokens, "TO") >= 0 else self.store.root
        ts, lsn = _find(tokens, "TIMESTAMP"), _find(tokens, "LSN")
        Store(self.spark, source).restore(target, until_ts=float(tokens[ts + 1].text) if ts >= 0 else None, until_version=int(tokens[lsn + 1].text) if lsn >= 0 else None)

    def _listen(self, tokens: list[Token]) -> None:
        self.listeners.setdefault(name(tokens[1]), [])

    def _notify(self, tokens: list[Token]) -> None:
        message = literal(tokens[-1]) if tokens[-1].kind == "string" else tokens[-1].text
        for heard in self.listeners.get(name(tokens[1]), []):
            heard(message)

    def listen(self, channel: str, heard: Callable[[str], None]) -> None:
        self.listeners.setdefault(channel, []).append(heard)

    def _explain(self, tokens: list[Token]) -> DataFrame:
        analyze = tokens[1].upper == "ANALYZE"
        rest = tokens[2 if analyze else 3 if _words(tokens[1:], 2) == ["QUERY", "PLAN"] else 1 :]
        df = self.query(rest)
        return explain.analyze(df) if analyze else explain.plan(df)


class Statement:
    """A prepared statement: values are bound by number from 1, rows come one by one from the executors."""

    def __init__(self, db: Database, tokens: list[Token]) -> None:
        self.db, self.tokens, self.values = db, tokens, {}
        self.reset()

    def bind(self, number: int, value: object) -> None:
        self.values[number] = value

    def step(self) -> bool:
        """Go to the next row; False after the last one, or at once for a statement without rows."""
        if self.rows is None:
            args = [self.values.get(i + 1) for i in range(max(self.values, default=0))]
            found = self.db.run(self.tokens, args)
            self.names = found.columns if found is not None else []
            self.rows = found.toLocalIterator() if found is not None else iter(())
        self.row = next(self.rows, None)
        return self.row is not None

    def column(self, at: int) -> object:
        return self.row[at]

    def reset(self) -> None:
        """Back to before the first row; bound values stay."""
        self.rows, self.row, self.names = None, None, []
