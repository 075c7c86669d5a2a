"""Quality rules whose cutoffs are chosen under an exact bound on false rejection. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import let, spare_name, words, written

SYMBOLS = "[#*$%&|<>]"
#: Each rule rejects a document whose figure is above its cutoff; cutoffs run from lenient to strict and are fixed beforehand.
RULES = {
    "symbol_share": [0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10, 0.08, 0.05],
    "dup_line_share": [0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40],
    "capital_share": [0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.35, 0.30],
    "exclaim_share": [0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10],
}
#: In each stratum, at most this share of good documents is rejected by the rules together ...
RISK = 0.01
#: ... save with this probability over all strata and rules.
DELTA = 0.05
#: Strata travel as one literal map; more than this many are refused rather than broadcast.
MOST_STRATA = 100_000
#: Terms of a binomial tail below this share of its largest term are left out.
TAIL = 1e-18


def _repeated_words(ws: Column) -> Column:
    """Words covered by windows of five that occur twice or more.

    Windows are sorted with their starts, so equal ones are neighbours; the union of the marked
    intervals is summed from the gaps between their sorted starts.
    """

    def neighbours(marked: Column) -> Column:
        sorted_ = F.array_sort(marked)
        same = let(sorted_, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))))
        starts = F.array_sort(F.array_distinct(F.flatten(F.array_compact(same))))
        covered = let(starts, lambda s: F.aggregate(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5)))), F.lit(0), lambda t, x: t + x))
        return F.when(F.size(starts) > 0, covered).otherwise(0)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda p: F.array_join(F.slice(w, p, 5), " "))

    def by_window(g: Column) -> Column:
        marked = F.transform(g, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), neighbours(marked)).otherwise(0)

    return F.when(F.size(ws) < 6, 0).otherwise(let(windows(ws), by_window)).cast("long")


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Whole-text figures of each row, with its columns ``keep``; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def figures(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeated_words(ws).alias("n_repeat_words"))

    found = docs.select(
        *keep,
        let(words(F.col("text")), figures).alias("_f"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclaims"),
    )
    return found.select(*keep, "_f.*", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), F.col("_l.n").alias("n_lines"), "n_capitals", "n_exclaims")


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def _figure(rule: str) -> Column:
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "capital_share": _share("n_capitals", "word_chars"),
        "exclaim_share": _share("n_exclaims", "word_chars"),
    }[rule]


def _log_factorial(n: Column) -> Column:
    """Exact by sum up to 20, Stirling's series beyond: an error under 1e-12."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    small = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(20)).cast("int")), F.lit(0.0), lambda t, i: t + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))
    return F.when(n <= 20, small).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, p), for k <= n p; 1 beyond, where no cutoff is ever taken.

    The terms fall geometrically below k, so they are summed downwards from it until they no
    longer count, which takes about sqrt(n p) of them.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, (F.lit(50) + 10 * F.sqrt(n.cast("double") * p)).cast("long")).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        j = k - i + 1
        term = F.when((i > 0) & (a["term"] > TAIL), a["term"] * j * (1 - p) / ((n - j + 1) * p)).otherwise(F.when(i > 0, F.lit(0.0)).otherwise(a["term"]))
        return F.struct(term.alias("term"), (a["sum"] + F.when(i > 0, term).otherwise(0.0)).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), steps), start, step, lambda a: a["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * tail))


def cutoffs(labelled: DataFrame, *, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from rows (stratum, quality, figures of the rules).

    Null hypothesis of a cutoff: it rejects more than ``risk`` / rules of the good documents of
    the stratum. Its p-value is the exact binomial tail of the rejections seen among the good
    held-out documents. Within a rule the cutoffs are tested from lenient to strict until the
    first that fails (fixed sequence, no loss of level); across strata and rules the level is
    divided (Bonferroni). So with probability 1 - ``delta`` no stratum loses more than ``risk``
    of its good documents to the rules.

    Strata with so few labels that no cutoff could pass, whatever it rejects, are tested together
    as one pooled stratum, for which the bound then holds as a whole. They are told by their
    label counts alone. If even the pool has too few labels, its strata get no cutoff.
    """
    each = risk / len(RULES)
    good = labelled.filter(F.col("quality") == 1)
    counts = good.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.sum((_figure(r) > c).cast("long")).alias(f"{r}_{i}") for r, cs in RULES.items() for i, c in enumerate(cs)],
    )
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("turn"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r, cs in RULES.items() for i, c in enumerate(cs)])
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.lit(delta / len(RULES)) / F.count("*").over(everything)
    counts = counts.withColumn("pool", F.when(F.pow(F.lit(1 - each), F.col("n")) <= least, F.col("stratum")))
    pools = counts.groupBy("pool").agg(*[F.sum(c).alias(c) for c in counts.columns if c not in ("stratum", "pool")])
    tested = pools.withColumn("strata", F.count("*").over(everything)).withColumn("tests", tests)
    tested = tested.select("pool", "n", "strata", F.explode("tests").alias("t")).select("pool", "n", "strata", "t.*")
    level = F.lit(delta / len(RULES)) / F.col("strata")
    tested = tested.withColumn("fails", (binomial_cdf(F.col("k"), F.col("n"), each) > level).cast("int"))
    so_far = Window.partitionBy("pool", "rule").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    passed = tested.withColumn("failed", F.sum("fails").over(so_far)).filter(F.col("failed") == 0)
    found = passed.groupBy(F.col("pool").alias("_pool"), "rule").agg(F.min("cutoff").alias("cutoff"))
    return counts.join(found, F.col("pool").eqNullSafe(F.col("_pool"))).select("stratum", "rule", "cutoff")


def verdicts(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the figures, base_failed, kept and the rule that rejected, for each row of ``docs``.

    Null and empty texts have no words and fail the base rules. A null stratum is one of its
    own. Labels of absent documents, of null quality or repeated for a doc_id with the same
    value count once; a doc_id with both labels counts as bad, so it sets no cutoff. Other
    columns of the inputs are ignored. Repeated rows are alike; texts are read whole. Without
    labels there are no cutoffs and the base rules decide; an empty table gives no rows. A
    figure that ties with its cutoff passes; of several rules the first in order is named.
    """
    named = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit("")).alias("stratum"), F.col("text").alias("text"))
    seen = written(features(named, ["doc_id", "stratum"]), "quality")
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_d")).agg(F.min("quality").alias("quality"))
    found = cutoffs(seen.join(marks, F.col("doc_id") == F.col("_d")), risk=risk, delta=delta)
    table = found.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x00", "stratum", "rule"), "cutoff"))).alias("m"))
    table = table.select(F.when(F.size("m") > MOST_STRATA * len(RULES), F.raise_error(F.lit("too many strata for one map"))).otherwise(F.col("m")).alias("m"))
    limits = spare_name(seen, "limits")
    judged = seen.withColumn(limits, table.scalar())
    over = [F.when(_figure(r) > F.try_element_at(F.col(limits), F.concat_ws("\x00", F.col("stratum"), F.lit(r))), F.lit(r)) for r in RULES]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = judged.withColumn("base_failed", base).withColumn("rejected_by", F.coalesce(*over))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
