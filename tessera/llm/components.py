"""Connected components of a graph by label propagation with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b: long); the label is the least node of the component.

    Each round takes the least label among a node's neighbours and then the label of its label,
    so the rounds grow with the logarithm of the longest path. Every round is written to the
    shared folder, which cuts the lineage. Loops and repeated edges do no harm; no edges give
    no rows.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        new = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        ahead = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = new.join(ahead, F.col("label") == F.col("_n")).select("node", "old", F.least("label", "_l").alias("label"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more edges (a, b): only the graph of the labels that they join is walked."""
    end = lambda c: labels.select(F.col("node").alias(f"_{c}"), F.col("label").alias(f"_l{c}"))
    named = edges.join(end("a"), F.col("a") == F.col("_a"), "left").join(end("b"), F.col("b") == F.col("_b"), "left")
    between = named.select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b")).filter("a != b").distinct()
    roots = components(between)
    moved = labels.join(roots.select(F.col("node").alias("_n"), F.col("label").alias("_r")), F.col("label") == F.col("_n"), "left")
    moved = moved.select("node", F.coalesce("_r", "label").alias("label"))
    return written(moved.union(roots.join(labels, "node", "left_anti").select("node", "label")), "labels")
