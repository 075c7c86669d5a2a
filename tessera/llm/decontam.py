"""Benchmark decontamination by n-gram windows. DataFrame and SQL functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, packed, text_key

WINDOW = 10
#: The distinct windows of the benchmark are counted up to this before they go into the plan as a hash set; beyond it they are joined.
MOST_BROADCAST = 50_000
#: Parts of the texts, by their hash, whose equal windows are joined apart; the benchmark's windows are repeated as often.
SALTS = 16
#: What lies between words once A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "array<struct<p:int,n:int,items:array<string>>>"


def normal_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; other letters stay as they are. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), GAPS), "")


def _starts(ws: Column, length: int) -> Column:
    return F.when(F.size(ws) >= length, F.sequence(F.lit(1), F.size(ws) - (length - 1))).otherwise(F.array().cast("array<int>"))


def _hashes(ws: Column, length: int) -> Column:
    return F.transform(_starts(ws, length), lambda p: F.struct(p.alias("p"), F.xxhash64(F.slice(ws, p, length)).alias("h")))


def _gram(ws: Column, p: Column, n: Column) -> Column:
    return F.array_join(F.slice(ws, p, n), " ")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(n, gram, h, items): the distinct windows of all items, their hash, and their items as sorted strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(window))
    grams = let(F.struct(F.col("ws").alias("ws"), size.alias("n")), lambda x: F.transform(F.sequence(F.lit(1), F.size(x["ws"]) - x["n"] + 1), lambda p: _gram(x["ws"], p, x["n"])))
    each = items.select("item", size.alias("n"), F.explode(grams).alias("gram"))
    found = each.groupBy("n", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.withColumn("h", F.xxhash64(F.split("gram", " ")))


def _scan(ws: Column, known: list) -> Column:
    """Windows of the words that occur in the benchmark: start, length, items.

    The set of window hashes is an ``IN`` set, which is one hash lookup a position. The few
    positions that pass are verified against the gram itself, which lies in a literal table
    of hash buckets.
    """
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(known)))]
    for r in known:
        buckets[r["h"] % len(buckets)].append({"g": r["gram"], "i": r["items"]})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<g:string,i:array<string>>>>")

    def of_length(n: int) -> Column:
        hashes = [r["h"] for r in known if r["n"] == n]
        passed = F.filter(_hashes(ws, n), lambda x: x["h"].isin(hashes))

        def verified(x: Column) -> Column:
            bucket = F.element_at(table, (F.pmod(x["h"], F.lit(len(buckets))) + 1).cast("int"))
            same = let(_gram(ws, x["p"], F.lit(n)), lambda g: F.filter(bucket, lambda b: b["g"] == g))
            return F.struct(x["p"].alias("p"), F.lit(n).alias("n"), F.try_element_at(same, F.lit(1))["i"].alias("items"))

        return F.filter(F.transform(passed, verified), lambda x: x["items"].isNotNull())

    each = [of_length(n) for n in sorted({r["n"] for r in known})]
    return F.concat(*each) if each else F.array().cast(_FOUND)


def _covered(spans: Column) -> Column:
    """Words in the union of spans (p, n)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))

    def step(a: Column, s: Column) -> Column:
        end = s["p"] + s["n"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(s["p"], a["to"]))).alias("n"), F.greatest(a["to"], end).alias("to"))

    return F.aggregate(F.array_sort(F.transform(spans, lambda x: F.struct(x["p"].alias("p"), x["n"].alias("n")))), start, step, lambda a: a["n"]).cast("long")


def _by_join(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``docs`` (row, text) with ``_found`` for a benchmark of any size: hashes of windows are joined, then grams compared.

    Each text is scanned once however often it is repeated. The join deals windows by their hash
    and by the text's part of SALTS, so a passage that many texts share goes to as many tasks.
    """
    marked = docs.withColumn("text_id", text_key(F.col("text")))
    texts = marked.select(F.col("text_id").alias("_t"), F.col("text").alias("_x")).dropDuplicates(["_t"])

    def of_length(w: Column, n: int) -> Column:
        return F.transform(_hashes(w, n), lambda x: F.struct(x["p"].alias("p"), F.lit(n).alias("n"), x["h"].alias("h")))

    every = lambda w: F.concat(F.array().cast("array<struct<p:int,n:int,h:bigint>>"), *[of_length(w, n) for n in lengths])
    spots = texts.select("_t", let(normal_words(F.col("_x")), every).alias("_s"))
    spots = spots.select("_t", F.explode("_s").alias("s")).select("_t", F.pmod(F.xxhash64("_t"), F.lit(SALTS)).alias("_salt"), "s.*")
    salted = windows.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hits = spots.join(salted, ["n", "h", "_salt"]).groupBy("_t").agg(F.collect_list(F.struct("p", "n", "gram", "items")).alias("_hits"))
    joined = marked.join(hits, F.col("text_id") == F.col("_t"), "left")
    checked = let(normal_words(F.col("text")), lambda ws: F.filter(F.col("_hits"), lambda x: _gram(ws, x["p"], x["n"]) == x["gram"]))
    found = F.transform(checked, lambda x: F.struct(x["p"].alias("p"), x["n"].alias("n"), x["items"].alias("items")))
    return joined.withColumn("_found", F.coalesce(found, F.array().cast(_FOUND))).drop("_t", "_hits", "text_id")


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``row``, each row of ``docs`` as a struct, its ``text``, and a struct ``_match``: n_words, n_hit, items (sorted strings), found (spans of words).

    A window is ``window`` consecutive words of an item; an item of fewer words, but at least
    one, is one window. A word of a document is hit if any occurrence of any window covers it.
    Null and wordless documents have no hits, wordless items no windows; items of null id
    cover words but aren't named. Repeated items count once, repeated rows are alike. Texts are
    read whole, whatever their length. Without rows there is no result, without items no hit.
    """
    rows = packed(docs, "text")
    windows = item_windows(benchmark, window)
    known = windows.limit(most_broadcast + 1).collect()
    if len(known) <= most_broadcast:
        scanned = lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _scan(ws, known).alias("found"))
        seen = rows.withColumn("_scan", let(normal_words(F.col("text")), scanned))
    else:
        lengths = [r["n"] for r in windows.select("n").distinct().collect()]
        joined = _by_join(rows, windows, lengths)
        seen = joined.withColumn("_scan", F.struct(F.size(normal_words(F.col("text"))).cast("long").alias("n_words"), F.col("_found").alias("found"))).drop("_found")
    items = F.array_sort(F.array_distinct(F.flatten(F.col("_scan.found.items"))))
    match = F.struct(F.col("_scan.n_words").alias("n_words"), _covered(F.col("_scan.found")).alias("n_hit"), items.alias("items"), F.col("_scan.found").alias("found"))
    return seen.withColumn("_match", match).drop("_scan")


def drop_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    return matches(docs, benchmark, **how).filter(F.col("_match.n_hit") == 0).select("row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """All documents, with the words of every benchmark window cut out of ``text``.

    What remains keeps its separators: the text is split into words and gaps, and a hit word
    goes together with the gap after it. Clean documents keep their text as it is.
    """
    seen = matches(docs, benchmark, **how)
    parts = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    spans = F.col("_match.found")
    kept = F.filter(parts, lambda x, i: ~F.exists(spans, lambda s: (i + 1 >= s["p"]) & (i + 1 < s["p"] + s["n"])))
    cut = seen.select("row", F.when(F.col("_match.n_hit") == 0, F.col("text")).otherwise(F.concat(lead, F.array_join(kept, ""))).alias("cut"))
    return cut.select(*[F.col("cut").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    seen = matches(docs.select("doc_id", "text"), benchmark)
    return seen.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("_match.n_words").alias("n_words"),
        F.col("_match.n_hit").alias("n_hit"),
        F.size("_match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_match.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_match.n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
), s AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
), h AS (
  SELECT s.r, s.n, s.p, g.item FROM s JOIN g ON s.n = g.n AND s.gram = g.gram
), c AS (
  SELECT r, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r
), i AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN i ON d.r = i.r
"""
