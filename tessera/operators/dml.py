"""Row changes as DataFrame operations: constraint checks, upserts, updates, deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.dialect import rewrite


class ConstraintError(ValueError):
    """Rows break a constraint of their table."""


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def same_key(a: DataFrame, b: DataFrame, keys: list[str], other: list[str] | None = None) -> Column:
    return _all([a[x] == b[y] for x, y in zip(keys, other or keys, strict=True)])


def check_rows(rows: DataFrame, table: dict, name: str) -> None:
    """NOT NULL, length limits and CHECK, all in one aggregate over the rows. A check that is null holds."""
    tests: list[tuple[str, Column]] = []
    for c in table["columns"]:
        column = F.col(f"`{c['name']}`")
        if c.get("not_null") or c["name"] in table["primary_key"]:
            tests.append((f"NOT NULL constraint failed: {name}.{c['name']}", column.isNull()))
        if c.get("length"):
            tests.append((f"value too long for {name}.{c['name']}", F.length(column) > c["length"]))
    tests += [(f"CHECK constraint failed: {name}: {x}", ~F.coalesce(F.expr(rewrite(x)), F.lit(True))) for x in table["checks"]]
    if not tests:
        return
    broken = rows.agg(*[F.coalesce(F.max(t), F.lit(False)).alias(f"t{i}") for i, (_, t) in enumerate(tests)]).first()
    for i, (message, _) in enumerate(tests):
        if broken[f"t{i}"]:
            raise ConstraintError(message)


def unique_sets(table: dict) -> list[list[str]]:
    keys = [table["primary_key"]] if table["primary_key"] else []
    return keys + [[c["name"]] for c in table["columns"] if c.get("unique") and [c["name"]] != table["primary_key"]]


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a key with a null never does."""
    return rows.dropna(subset=keys).groupBy(*keys).count().filter("count > 1").drop("count")


def check_unique(rows: DataFrame, existing: DataFrame, table: dict, name: str) -> None:
    for keys in unique_sets(table):
        if not repeated(rows.select(*keys).union(existing.join(rows.select(*keys).distinct(), keys, "left_semi").select(*keys)), keys).isEmpty():
            raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{name}.{k}' for k in keys)}")


def check_parents(rows: DataFrame, column: str, parent: DataFrame, parent_column: str, message: str) -> None:
    keys = rows.select(F.col(column).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    if not keys.join(parent.select(F.col(parent_column).alias("_p")), F.col("_k") == F.col("_p"), "left_anti").isEmpty():
        raise ConstraintError(message)


def index_keys(rows: DataFrame, keys: list[str], where: str | None) -> DataFrame:
    """The keys of an index, which may be expressions, of the rows that it covers."""
    covered = rows if where is None else rows.filter(rewrite(where))
    return covered.select(*[F.expr(rewrite(k)).alias(f"key{i}") for i, k in enumerate(keys)])


def one_of_each(rows: DataFrame, keys: list[str], turn: str, *, last: bool) -> DataFrame:
    """The last or the first row of each key in order of ``turn``, which goes."""
    columns = [c for c in rows.columns if c != turn]
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*columns), F.col(turn)).alias("_row")).select("_row.*")


def numbered(rows: DataFrame, mid: str, to: str) -> DataFrame:
    """``rows`` with ``to``: 1, 2, ... in order of ``mid``, a stored ``monotonically_increasing_id``.

    Each partition's rows are numbered by their offset, and a small row per partition carries
    the count of those before it, so no task sees more than its own rows.
    """
    marked = rows.withColumn("_part", F.shiftright(mid, 33))
    parts = marked.groupBy("_part").agg(F.count("*").alias("_rows"), F.min(mid).alias("_first"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_rows")
    found = marked.join(parts, "_part")
    return found.withColumn(to, F.col("_before") + F.col(mid) - F.col("_first") + 1).drop("_part", "_first", "_before", mid)


def without_conflicts(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, one of each key, whose key the table hasn't yet."""
    return rows.join(existing.select(*keys), keys, "left_anti").select(*rows.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], sets: dict[str, Column] | None = None) -> DataFrame:
    """``existing`` with ``incoming`` merged by key, as one full join.

    Without ``sets`` an incoming row replaces the one of its key; with them, only those columns
    of the existing row change. They may use columns of the existing row, and ``excluded.*``
    for the incoming one. ``incoming`` has a key once at most.
    """
    old, new = existing.alias("old"), incoming.alias("excluded")
    match = _all([F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in keys])
    both = old.withColumn("_old", F.lit(True)).alias("old").join(new.withColumn("_new", F.lit(True)).alias("excluded"), match, "full")
    is_old, is_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    columns = []
    for c in existing.columns:
        was, comes = F.col(f"old.`{c}`"), F.col(f"excluded.`{c}`")
        merged = comes if sets is None else sets.get(c, was)
        columns.append(F.when(is_old & is_new, merged).when(is_new, comes).otherwise(was).alias(c))
    return both.select(*columns)


def folded(existing: DataFrame, incoming: DataFrame, keys: list[str], sets: dict[str, str], turn: str) -> DataFrame:
    """``existing`` after the upserts of ``incoming``, one after another in order of ``turn``, whose keys may repeat.

    The first row of a new key is inserted, every other one changes what is there by then:
    ``sets`` are SQL expressions over ``old`` and ``excluded``. One join and one fold per key.
    """
    columns = existing.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    queue = incoming.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), row.alias("r")))), lambda x: x["r"]).alias("_queue"))
    both = existing.select(*keys, row.alias("_old")).join(queue, keys, "full")
    step = ", ".join(f"'{c}', {sets.get(c, f'old.`{c}`')}" for c in columns)
    start = F.coalesce(F.col("_old"), F.col("_queue")[0])
    rest = F.when(F.col("_old").isNotNull(), F.col("_queue")).otherwise(F.slice("_queue", 2, F.greatest(F.size("_queue"), F.lit(1))))
    folded_ = both.withColumn("_start", start).withColumn("_rest", rest).withColumn("_row", F.expr(f"aggregate(coalesce(_rest, slice(array(_start), 1, 0)), _start, (old, excluded) -> named_struct({step}))"))
    return folded_.select("_row.*")


def update(rows: DataFrame, condition: Column, sets: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return rows.select(*[F.when(hit, sets[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in sets else F.col(f"`{c}`") for c in rows.columns])


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def unexpired(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    """Rows whose time hasn't passed: a row is dead when its time is before ``now``."""
    return rows.filter(F.col(expires).isNull() | (F.col(expires) >= now))
