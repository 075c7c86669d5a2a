"""Mixing sources to target weights by systematic sampling. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ranked_within, text_key, words, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its own size.
MOST_COPIES = 3
SEED = "mix-1"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size) with the target of each: one row per source goes through one task.

    Water level: sources in ascending order of limit per weight. A source is full if the level
    at its turn (what is left, shared among it and all later ones by weight) reaches its limit.
    Sizes are exact integers, so the result doesn't depend on the order of summation.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    limited = sources.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_w").over(rest)
    levelled = limited.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_limit"))
    water = F.min(F.when(~F.col("_full"), F.struct(F.col("_limit") / F.col("_w"), F.col("source").isNull(), F.col("source"), F.col("_level"))))
    water = water.over(everything).getField("_level")
    target = F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(water * F.col("_w"))
    return levelled.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "target")


def offset(source: Column, seed: str = SEED) -> Column:
    """The random start of a source, in [0, 1): the same in every run."""
    named = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return F.conv(F.substring(named, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def plan_copies(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per document: doc_id, source, size, source_size, target, copies, its text key and its columns ``keep``.

    A document's expected copies are its source's target over its source's size. They are
    prefix-summed within the source, shifted by one random offset, and a document comes out
    once for every integer that its step crosses. Documents are taken in order of size, so
    every size is drawn evenly and the words come close to the target. Numbering and sums
    are distributed: a source may hold any share of the rows.

    Null and wordless texts have size 0: they count as documents, take no words and change no
    target. A null source is a source of its own, last in order. If all is empty every target
    is 0. Rows that repeat a doc_id are separate documents; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), text_key(F.col("text")).alias("text_id"), *keep)
    order = [F.col("size"), F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("text_id")]
    ranked = ranked_within(narrow, "source", order, "mix")
    sizes = ranked.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    found = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    step = lambda k: F.floor(rate * k + offset(F.col("source"), seed))
    return found.withColumn("copies", (step(F.col("rank_in_group")) - step(F.col("rank_in_group") - 1)).cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as its copies, with its own columns.

    The rows are written with a number of their own, by which the copies come back to them, so
    rows that repeat in everything never meet. Which of those are taken may differ between runs.
    """
    numbered = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("turn")), "numbered")
    plan = plan_copies(numbered.select("row.doc_id", "row.source", "row.text", "turn"), keep=("turn",), **how)
    found = numbered.join(plan.filter("copies > 0").select("turn", F.col("copies").cast("int").alias("copies")), "turn")
    return found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("again")).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    plan = plan_copies(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce('t' || text, 'n')) AS text_id
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s
), l AS (
  SELECT *, source_size * 3 AS lim,
    ((sum(source_size) OVER ())::BIGINT
      - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
    row_number() OVER o AS turn
  FROM w WINDOW o AS (ORDER BY (source_size * 3)::DOUBLE / w, source ASC NULLS LAST)
), f AS (
  SELECT *, level * w >= lim AS is_full FROM l
), t AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN lim::DOUBLE
         ELSE (SELECT arg_min(level, turn) FROM f AS g WHERE NOT g.is_full) * w END AS target,
    ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'n')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(d.doc_id::VARCHAR), d.doc_id, d.text_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT * size AS taken
FROM r
"""
