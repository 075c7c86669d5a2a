"""Sharding by Karmarkar-Karp differencing: shards of near equal bytes, groups of equal texts kept whole."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ranked_within, text_key, written

SHARDS = 8
#: A group of at least 1 / (shards * GRAIN) of all bytes is an item of its own, so there are at most shards * GRAIN of them.
GRAIN = 1024
#: All lighter groups are dealt by their hash into this many items.
BINS = 8192


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item. Multiway largest differencing method.

    Every item starts as a partial partition with itself in one part. The two partial
    partitions of the largest spread are combined, the heaviest part of one with the lightest
    of the other, and so on, until one is left.
    """
    if not sizes:
        return []
    heap = []
    for i, size in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        parts = [(0, [])] * (shards - 1) + [(size, [i])]
        heap.append((-size, i, parts))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Members are nested pairs, so that combining doesn't copy them.
        parts = sorted(((x + y, [m, n]) for (x, m), (y, n) in zip(a, reversed(b), strict=True)), key=lambda x: x[0])
        least = parts[0][0]
        parts = [(x - least, m) for x, m in parts]
        heapq.heappush(heap, (-parts[-1][0], made, parts))
        made += 1
    found = [0] * len(sizes)
    for shard, (_, members) in enumerate(heap[0][2]):
        todo = [members]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            else:
                found[x] = shard
    return found


def text_bytes(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def group_key(text: Column) -> Column:
    """Equal texts are a group; null goes with the empty text."""
    return text_key(F.coalesce(text, F.lit("")))


def _bin(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BINS)).cast("int")


def assign(rows: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """``rows`` (group_id, size, ...) with ``shard``.

    The items that are partitioned on the driver are the heavy groups and BINS bins of light
    ones: at most shards * GRAIN + BINS of them at any size of the corpus, each too small to
    upset the balance unless it is a single heavy group.
    """
    groups = written(rows.groupBy("group_id").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    heavy = F.col("bytes") * (shards * GRAIN) >= F.lit(total)
    items = [(r["group_id"], None, r["bytes"]) for r in groups.filter(heavy).collect()]
    items += [(None, r["bin"], r["bytes"]) for r in groups.filter(~heavy).groupBy(_bin(F.col("group_id")).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()]
    items.sort(key=lambda x: (-x[2], x[0] is None, bytes(x[0] or b""), x[1] or 0))
    shard = difference([x[2] for x in items], shards)
    spark = rows.sparkSession
    large = spark.createDataFrame([(bytes(k), s) for (k, _, _), s in zip(items, shard, strict=True) if k is not None], "_k binary, _ks int")
    small = spark.createDataFrame([(b, s) for (_, b, _), s in zip(items, shard, strict=True) if b is not None], "_b int, _bs int")
    # Both tables have a fixed number of rows at most, so they may be broadcast.
    found = rows.join(F.broadcast(large), F.col("group_id") == F.col("_k"), "left")
    found = found.join(F.broadcast(small), _bin(F.col("group_id")) == F.col("_b"), "left")
    return found.withColumn("shard", F.coalesce("_ks", "_bs")).drop("_k", "_ks", "_b", "_bs")


def place(docs: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of ``docs``, by the law ``bytes``.

    Size is the text's UTF-8 bytes plus 1; null counts as empty. Rows of equal texts share a
    shard. Slots run from 0 in each shard in order of doc_id (null first), then text; rows that
    repeat both are interchangeable. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id").alias("doc_id"), text_bytes(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_key(F.col("text")).alias("group_id"))
    placed = assign(written(narrow, "sizes"), shards=shards)
    ranked = ranked_within(placed, "shard", [F.col("doc_id"), F.col("group_id")], "slots")
    return ranked.withColumn("slot", F.col("rank_in_group") - 1).drop("rank_in_group")


def query(docs: DataFrame) -> DataFrame:
    return place(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


