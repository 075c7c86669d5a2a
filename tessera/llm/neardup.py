"""Near-duplicate documents by BagMinHash signatures of word shingles, banded and verified by multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import packed, text_key, words, written
from tessera.llm.components import components, merged

#: Words of a shingle, and the least weighted Jaccard similarity, as a fraction, of shingle multisets.
SHINGLE, SIMILAR = 5, (4, 5)
#: At similarity 0.8 a pair is missed with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 32, 5
SIGNATURE = BANDS * ROWS
#: Words whose documents are signed at once, which bounds memory.
BLOCK = 200_000
#: Earlier shared elements that go with an element of a prefix, so that a pair is listed about once.
RECENT = 16
#: Classes of size, per factor e, within which holders of a rare shingle are compared with one of them.
CLASSES = 16

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _times(n: int) -> np.uint64:
    return np.uint64(n * int(_GOLDEN) & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the windows of SHINGLE words; a shorter text is one shingle, a wordless one none."""
    w = hashes.view(np.uint64)
    length = min(SHINGLE, len(w))
    if not length:
        return w
    found = np.full(len(w) - length + 1, np.uint64(length))
    for i in range(length):
        found = mix(found * _GOLDEN + w[i : len(w) - length + 1 + i])
    return found


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(hashes), return_counts=True)


def _gap(r: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Exponential waiting times of processes of rate ``width``, from the upper 40 bits of ``r``."""
    return -np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / width


def sign(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIGNATURE) -> np.ndarray:
    """BagMinHash: row i is the signature of the i-th non-empty bag.

    Each element has a Poisson process over (time, weight), weights in unit steps. It is a
    hierarchy: the intervals [0, 1), [1, 2), [2, 4), [4, 8), ... of the weight axis have
    processes of a rate equal to their width, and one that is wider than a unit is split when
    its first point comes up: one half, by a coin, inherits the point, the other one gets a
    first point after a further wait. Halves that begin at or above the bag's weight of the
    element are dropped, so an element of weight w costs about log w splits for each point. The
    points of unit intervals carry a component, and a component's signature is its first point.
    Coins and waits depend on the element and the interval alone, so bags see the same points
    where their weights overlap. The first point of a union is equally likely to be anywhere in
    it, so two components agree with probability sum(min) / sum(max), the weighted Jaccard
    similarity.

    Only points up to a time by which all components are likely to have one are made; bags that
    still lack one are signed again to twice that time.
    """
    found = np.zeros((len(bags), size), dtype=np.uint64)
    todo, reach = np.arange(len(bags)), np.log(size) + 4
    while len(todo):
        doc, key, low, width, limit = [], [], [], [], []
        total = np.array([bags[i][1].sum() for i in todo], dtype=np.float64)
        for at, i in enumerate(todo):
            elements, counts = bags[i]
            for j in range(int(counts.max() - 1).bit_length() + 1):
                start = 1 << (j - 1) if j else 0
                has = slice(None) if j == 0 else counts > start
                e = elements[has]
                doc.append(np.full(len(e), at))
                key.append(mix(e + _times(j)))
                low.append(np.full(len(e), start))
                width.append(np.full(len(e), max(1, start)))
                limit.append(counts[has])
        doc, key, low, width, limit = (np.concatenate(x) for x in (doc, key, low, width, limit))
        stop = size * reach / total
        time, turn = _gap(mix(key), width), np.ones(len(doc), dtype=np.uint64)
        cells, times, points = [], [], []
        while len(doc):
            near = time <= stop[doc]
            if not near.all():
                doc, key, low, width, limit, time, turn = (x[near] for x in (doc, key, low, width, limit, time, turn))
            r = mix(key + turn * _GOLDEN)
            unit = width == 1
            u = slice(None) if unit.all() else unit
            cells.append(doc[u] * size + ((r[u] & np.uint64(0xFFFFFF)) * np.uint64(size) >> np.uint64(24)).astype(np.int64))
            times.append(time[u])
            points.append(r[u])
            following = [(doc[u], key[u], low[u], width[u], limit[u], time[u] + _gap(r[u], 1), turn[u] + np.uint64(1))]
            if not isinstance(u, slice):
                doc, key, low, width, limit, time, r = (x[~unit] for x in (doc, key, low, width, limit, time, r))
                width = width // 2
                right = (r & np.uint64(1)).astype(bool)
                later = time + _gap(r, width)
                for side, first in ((0, np.where(right, later, time)), (1, np.where(right, time, later))):
                    start = low + side * width
                    has = start < limit
                    following.append(tuple(x[has] for x in (doc, mix(key + _times(2 + side)), start, width, limit, first, np.ones(len(doc), dtype=np.uint64))))
            doc, key, low, width, limit, time, turn = (np.concatenate(x) for x in zip(*following, strict=True)) if len(following) > 1 else following[0]
        cells, times, points = (np.concatenate(x) for x in (cells, times, points))
        order = np.argsort(times)[::-1]
        sketch, filled = np.zeros(len(todo) * size, dtype=np.uint64), np.zeros(len(todo) * size, dtype=bool)
        sketch[cells[order]] = points[order]
        filled[cells] = True
        done = filled.reshape(-1, size).all(axis=1)
        found[todo[done]] = sketch.reshape(-1, size)[done]
        todo, reach = todo[~done], 2 * reach
    return found


def bands(signatures: np.ndarray) -> np.ndarray:
    """One hash per band of ROWS components; the band's number goes in."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    found = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        found = mix(found * _GOLDEN + parts[:, :, i])
    return found


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("words")
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)
        at = 0
        while at < len(batch):
            to = at + 1
            while to < len(batch) and offsets[to + 1] - offsets[at] <= BLOCK:
                to += 1
            bags = [bag(values[offsets[i] : offsets[i + 1]]) for i in range(at, to)]
            keys = np.zeros((to - at, BANDS), dtype=np.uint64)
            some = [i for i, b in enumerate(bags) if len(b[0])]
            if some:
                keys[some] = bands(sign([bags[i] for i in some]))
            lists = [keys[i].view(np.int64) if len(b[0]) else np.empty(0, dtype=np.int64) for i, b in enumerate(bags)]
            sizes = [int(b[1].sum()) for b in bags]
            yield pa.RecordBatch.from_arrays([batch.column("text_id").slice(at, to - at), batch.column("doc_id").slice(at, to - at), pa.array(lists, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["text_id", "doc_id", "keys", "size"])
            at = to


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose multisets overlap enough: sum(min) / sum(max) >= SIMILAR."""
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        bags: dict = {}
        keep = []
        for i in range(len(batch)):
            key = batch.column("a")[i].as_py()
            if key not in bags:
                bags = {key: bag(left[i].values.to_numpy(zero_copy_only=False))}  # pairs of one a come together
            (x, nx), (y, ny) = bags[key], bag(right[i].values.to_numpy(zero_copy_only=False))
            _, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            shared = int(np.minimum(nx[ix], ny[iy]).sum())
            keep.append(SIMILAR[1] * shared >= SIMILAR[0] * (int(nx.sum()) + int(ny.sum()) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar; ``texts`` has node and text."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("_rt")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_lt")), "a")
    return both.select("a", "b", _hashes(F.col("_lt")).alias("left"), _hashes(F.col("_rt")).alias("right")).mapInArrow(_verify_batches, "a long, b long")


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, nodes = batch.column("words"), batch.column("node").to_numpy()
        for i in range(len(batch)):
            found, weights = bag(lists[i].values.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), nodes[i])), pa.array(found.view(np.int64)), pa.array(weights.astype(np.int64))], names=["node", "shingle", "weight"])


def _mixed(members: DataFrame) -> DataFrame:
    """The members (key, node, size, label) of buckets that hold more than one component, with the bucket's least size.

    The buckets are written, so that the join stands alone and a large bucket may be split.
    """
    keys = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("size").alias("least"))
    return members.join(written(keys.filter("lo != hi").select("key", "least"), "mixed"), "key")


def _promising(left: DataFrame, shingled: DataFrame) -> DataFrame:
    """Nodes (node, size, label) of ``left`` that may still have a similar partner in another component.

    No overlap is larger than the weight of a node's shingles that any other node of ``left``
    has too. A node goes if even the smallest member of each of its buckets, shared to that
    extent, isn't similar to it: an exact bound, so no link is lost. It clears out the copies
    that were edited so often that they are similar to nothing.
    """
    alone = shingled.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).filter("n = 1")
    alone = alone.groupBy("node").agg(F.sum("weight").alias("alone"))
    nodes = left.groupBy("node", "size", "label").agg(F.min("least").alias("least"))
    known = nodes.join(alone, "node", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0)))
    partner = F.greatest("least", "common")
    return known.filter(sum(SIMILAR) * F.col("common") >= SIMILAR[0] * (F.col("size") + partner)).select("node", "size", "label")


def _prefixes(nodes: DataFrame, shingled: DataFrame) -> DataFrame:
    """(element, node, size, label, before, recent): the elements by which similar nodes must meet.

    Bags are read as sets of (shingle, occurrence), in one order for all, rare ones first. Two
    bags of similarity t share more than t of either, so they share an element among the first
    1 - t of each. ``before`` counts the elements of the node that come earlier, ``recent`` are the
    RECENT ones of them that others have too.
    """
    occurrences = F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))
    each = shingled.join(nodes, "node").withColumn("nth", occurrences).select("node", "size", "label", F.when(F.col("nth") == 1, F.col("shingle")).otherwise(F.xxhash64("shingle", "nth")).alias("element"))
    counts = each.groupBy("element").agg(F.count("*").alias("n"))
    order = Window.partitionBy("node").orderBy("n", "element")
    ranked = each.join(counts, "element").withColumn("before", F.row_number().over(order) - 1)
    shared = ranked.filter((F.col("n") > 1) & (SIMILAR[1] * F.col("before") <= (SIMILAR[1] - SIMILAR[0]) * F.col("size")))
    recent = F.collect_list("element").over(order.rowsBetween(-RECENT, -1))
    return shared.withColumn("recent", recent).select("element", "node", "size", "label", "before", "recent")


def _enough(x: str, y: str) -> Column:
    """Whether what two bags have from a shared element on lets them be similar: a shared element that is their first one must pass."""
    rest = F.least(F.col(f"{x}.size") - F.col(f"{x}.before"), F.col(f"{y}.size") - F.col(f"{y}.before"))
    return sum(SIMILAR) * rest >= SIMILAR[0] * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _stars(prefix: DataFrame) -> DataFrame:
    """Pairs of each holder of an element with one of its holders of like size that has it foremost: as many as there are rows."""
    sized = prefix.withColumn("class", F.floor(F.log("size") * CLASSES))
    drawn = sized.groupBy("element", "class").agg(F.max_by(F.struct("node", "label", "size", "before"), F.struct(-F.col("before"), F.xxhash64("element", "node"))).alias("y"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    drawn = written(drawn.filter("lo != hi").select("element", "class", "y"), "drawn")
    found = sized.alias("x").join(drawn, ["element", "class"]).filter((F.col("x.label") != F.col("y.label")) & _enough("x", "y"))
    return found.select(*_pair("x", "y")).distinct()


def _across(prefix: DataFrame) -> DataFrame:
    """All pairs (a, b) of nodes in different components that may be similar.

    Of the elements that two nodes share, a pair is listed at the first: where an earlier one is
    among the recent elements of both, it isn't.
    """
    mixed = prefix.groupBy("element").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("element")
    open_ = written(prefix.join(written(mixed, "mixed"), "element"), "across")
    first = ~F.arrays_overlap("x.recent", "y.recent")
    found = open_.alias("x").join(open_.alias("y"), (F.col("x.element") == F.col("y.element")) & (F.col("x.label") < F.col("y.label")) & _enough("x", "y") & first)
    return found.select(*_pair("x", "y")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, class_id) of each row of ``docs``: class_id is the least doc_id of its class.

    A class is a connected component of the documents under weighted Jaccard similarity of 0.8
    or more of their multisets of five-word shingles. Exact copies are one node of the graph,
    so a group of copies costs one signature row. In each band's bucket all members are
    compared with three leaders, the least by three fixed orders, so a bucket of any size gives
    a linear number of pairs. The members of buckets that are then still in several components
    and that an exact bound on their overlap leaves are compared by their shared rare shingles:
    first each holder of such a shingle with one of its holders, which is linear too and joins
    what is near, then the components that remain apart with each other, each pair once and only
    where the position of the shared shingle allows similarity 0.8. No link of a bucket is lost,
    and pairs within a component are never listed.

    A null text is a class of its own, with its doc_id; wordless texts are similar to exact
    copies only. Texts under five words are one shingle. A null doc_id is the least only where
    all others are null. Rows that repeat doc_id and text have the same class; an empty table
    gives no rows; very long texts are signed whole, by themselves. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    some = rows.filter(F.col("text").isNotNull()).withColumn("text_id", text_key(F.col("text")))
    signed = some.select("text_id", "doc_id", _hashes(F.col("text")).alias("words")).mapInArrow(_sign_batches, "text_id binary, doc_id long, keys array<long>, size long")
    once = signed.groupBy("text_id").agg(F.min("doc_id").alias("first_doc"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    nodes = written(once.withColumn("node", F.monotonically_increasing_id()), "nodes")

    exploded = nodes.select(F.explode("keys").alias("key"), "node", "size")
    order = lambda i: F.xxhash64(F.lit(i), F.col("node"))
    buckets = exploded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("l0"), F.min_by("node", order(1)).alias("l1"), F.min_by("node", order(2)).alias("l2")).filter("n > 1")
    members = written(exploded.join(written(buckets.drop("n"), "buckets"), "key"), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "text_id"), "node")
    texts = some.select("text_id", "text").join(wanted, "text_id").dropDuplicates(["node"]).select("node", "text")
    texts = written(texts, "texts")

    pairs = members.select("node", F.explode(F.array("l0", "l1", "l2")).alias("leader")).filter("node != leader")
    pairs = written(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs")
    labels = components(verify(pairs, texts))

    labelled = lambda rows: rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = written(_mixed(written(labelled(members.select("key", "node", "size")), "named")), "open")
    shingled = texts.join(left.select("node").distinct(), "node").select("node", _hashes(F.col("text")).alias("words"))
    shingled = written(shingled.mapInArrow(_shingle_batches, "node long, shingle long, weight long"), "shingles")
    prefix = written(_prefixes(_promising(left, shingled), shingled), "prefix")
    stars = written(_stars(prefix).join(pairs, ["a", "b"], "left_anti"), "stars")
    labels = merged(labels, verify(stars, texts))
    across = _across(labelled(prefix.drop("label")))
    across = written(across.join(pairs.union(stars), ["a", "b"], "left_anti"), "pairs")
    labels = merged(labels, verify(across, texts))

    known = nodes.select("node", "text_id", "first_doc").join(labels, "node", "left")
    joined = known.filter(F.col("label").isNotNull())
    firsts = joined.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    node_class = joined.join(firsts, "label").select("text_id", "class_id")
    node_class = node_class.union(known.filter(F.col("label").isNull()).select("text_id", F.col("first_doc").alias("class_id")))
    found = some.select("doc_id", "text_id").join(node_class, "text_id")
    alone = rows.filter(F.col("text").isNull()).select("doc_id", text_key(F.lit(None).cast("string")).alias("text_id"), F.col("doc_id").alias("class_id"))
    return found.select("doc_id", "text_id", "class_id").union(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of its least doc_id. Of rows that repeat doc_id and text one stays; null texts stay.

    Repeated rows are reduced to one by each task before they are shuffled, so none of them meet in a crowd.
    """
    kept = classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).distinct()
    marked = packed(docs, "doc_id", "text").withColumn("text_id", text_key(F.col("text")))
    once = marked.filter(F.col("text").isNotNull()).groupBy("doc_id", "text_id").agg(F.first("row").alias("row"))
    found = once.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("text_id") == F.col("_t")), "left_semi")
    return found.select("row.*").union(docs.filter(F.col("text").isNull()))


def query(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id")
