"""Line dedup by pairwise alignment: documents that share rare lines are aligned by patience diff, and the later one loses the common blocks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, ranked_within, spare_name, text_key, words, written

#: A line of fewer words is no evidence of overlap, and a block of fewer stays where it is.
LEAST_WORDS = 5
#: A line is rare if at most this share of all documents has it. Pairs are linear in copies of
#: lines, so by default even the line that most documents have counts, and no case is left out.
RARE_SHARE = 1.0
#: Rounds with later holders try those of ranks 2 to 7, 8 to 31 and so on, so there are few; a
#: round of at most so many pairs broadcasts their documents' ids rather than shuffle all texts.
GROWTH, MOST_BROADCAST = 4, 50_000


def lines(text: Column) -> Column:
    """The text cut at each newline; null has no lines."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def line_hashes(text: Column) -> Column:
    """64-bit hash of each line; null for lines without a word, which are never evidence nor aligned."""
    return F.transform(lines(text), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(x)))


def _anchors(a: Sequence, b: Sequence, ai: range, bi: range) -> list[tuple[int, int]]:
    """The longest increasing run of lines that are unique in both ranges (patience sorting)."""
    na, nb = Counter(a[i] for i in ai), Counter(b[j] for j in bi)
    at = {b[j]: j for j in bi if nb[b[j]] == 1}
    pairs = [(i, at[a[i]]) for i in ai if a[i] is not None and na[a[i]] == 1 and a[i] in at]
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[pile], ends[pile] = j, k
    found, k = [], ends[-1] if ends else -1
    while k >= 0:
        found.append(pairs[k])
        k = back[k]
    return found[::-1]


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of equal lines of two texts, increasing in both; None equals nothing.

    Equal lines at either end of a stretch are paired first, then lines that are unique in both
    split it and the stretches between them are aligned in turn. A stretch without such lines
    isn't aligned any further.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] is not None and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] is not None and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            found.append((k, m))
        if i >= k or j >= m:
            continue
        anchors = _anchors(a, b, range(i, k), range(j, m))
        for x, y in anchors:
            todo.append((i, x, j, y))
            found.append((x, y))
            i, j = x + 1, y + 1
        if anchors:
            todo.append((i, k, j, m))
    return sorted(found)


def blocks(pairs: list[tuple[int, int]], a: Sequence, b: Sequence, sizes: Sequence, least: int = LEAST_WORDS) -> list[int]:
    """Lines of the second text that lie in aligned blocks of ``least`` words or more; wordless lines don't break a block."""
    found, block, words = [], [], 0
    for k, (i, j) in enumerate(pairs):
        if k:
            x, y = pairs[k - 1]
            if any(v is not None for v in a[x + 1 : i]) or any(v is not None for v in b[y + 1 : j]):
                found += block if words >= least else []
                block, words = [], 0
        block.append(j)
        words += sizes[j]
    return found + (block if words >= least else [])


def evidence(a: Sequence, sizes: Sequence, least: int = LEAST_WORDS, beside: bool = True) -> dict[int, list[int]]:
    """{key: indices of the lines it may remove}: the line itself if it has ``least`` words.

    With ``beside``, a shorter line has the smallest runs of successive lines around it that
    reach ``least`` words together with a line that alone does: any block that takes the line has one of them.
    """
    found, at = defaultdict(list), [i for i, x in enumerate(a) if x is not None]
    for k, j in enumerate(at):
        if sizes[j] >= least:
            found[a[j]].append(j)
            continue
        before, x = 0, k
        while beside and x >= 0 and before < least:
            before += sizes[at[x]]
            y, total = k, before
            while total < least and y + 1 < len(at):
                y += 1
                total += sizes[at[y]]
            run = at[x : y + 1]
            if total >= least and (x == k or total - sizes[at[x]] < least) and any(sizes[i] >= least for i in run):
                key = 0
                for i in run:
                    key = ((key ^ key >> 29) * 0x9E3779B97F4A7C15 + a[i] + 1) % 2**64
                found[key - 2**63].append(j)
            x -= 1
    return found


def removals(docs: DataFrame, *, rare_share: float = RARE_SHARE, least_words: int = LEAST_WORDS, every: bool = False) -> DataFrame:
    """(doc_id, text_id, gone): for each document that loses lines, the sorted indices of those lines.

    Documents are ordered by doc_id (null first), then text. For every rare line that several
    documents have, each of them is paired with the first that has it: as many pairs as there
    are copies of lines, whatever the size of a group. Each pair is aligned once, and the later
    document loses the aligned blocks of ``least_words`` words or more. No line of that length
    leaves the corpus: its first document never loses it to an earlier one. Rows that share doc_id and text are one document.

    With ``every``, lines that survive are tried with their next holders, until they are gone or
    no earlier holder is left; the result is that of aligning each document with every earlier
    one that shares a line. Only survivors and their holders are read again.
    """
    sizes = F.transform(lines(F.col("text")), lambda x: F.size(words(x)))
    keyed = docs.select(F.struct(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("text_id")).alias("doc"), line_hashes(F.col("text")).alias("lines"), sizes.alias("sizes"))
    known = written(keyed.select("doc.doc_id", "doc.text_id", "lines", "sizes").dropDuplicates(["doc_id", "text_id"]), "lines")
    total = known.count()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, ats = [], [], []
            for row, (a, n) in enumerate(zip(batch.column("lines").to_pylist(), batch.column("sizes").to_pylist(), strict=True)):
                found = evidence(a, n, least_words, every)
                rows += [row] * len(found)
                names += found.keys()
                ats += found.values()
            ids = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "text_id")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(names, pa.int64()), pa.array(ats, pa.list_(pa.int32()))], names=["doc_id", "text_id", "line", "at"])

    each = known.mapInArrow(keys, f"doc_id {id_type}, text_id binary, line long, at array<int>")
    each = each.select("line", F.struct("doc_id", "text_id").alias("doc"), "at")
    shared = each.groupBy("line").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    shared = shared.filter((F.col("n") > 1) & (F.col("n") <= F.lit(rare_share * total)))
    copies = written(each.join(shared, "line").filter(F.col("doc") != F.col("first")), "copies")
    own = known.select(F.struct("doc_id", "text_id").alias("doc"), "lines", "sizes")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*[batch.column(c).to_pylist() for c in ("first_lines", "lines", "sizes")], strict=True)
            gone = pa.array([blocks(align(a, b), a, b, n, least_words) for a, b, n in sides], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), gone], names=["doc_id", "text_id", "gone"])

    def lost(pairs: DataFrame, own: DataFrame) -> DataFrame:
        later = pairs.join(own, "doc")
        both = later.join(own.select(F.col("doc").alias("first"), F.col("lines").alias("first_lines")), "first")
        both = both.select("doc.doc_id", "doc.text_id", "first_lines", "lines", "sizes")
        return both.mapInArrow(aligned, f"doc_id {id_type}, text_id binary, gone array<int>")

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("doc_id", "text_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))

    def surviving(rows: DataFrame, gone: DataFrame) -> DataFrame:
        marks = gone.select(F.struct("doc_id", "text_id").alias("doc"), "gone")
        return rows.join(marks, "doc").filter(F.size(F.array_except("at", "gone")) > 0).drop("gone")

    gone = merged(lost(copies.select("doc", "first").distinct(), own))
    if not every:
        return gone
    gone = written(gone, "gone")
    alive = written(surviving(copies.filter(F.col("n") > 2).select("doc", "line", "at"), gone), "alive")
    if alive.isEmpty():
        return gone
    # Holders of the survivors' lines, ranked; the first has rank 1 and has been tried.
    held = copies.join(alive.select("line").distinct(), "line", "left_semi")
    held = held.select("line", "doc").union(held.select("line", "first").distinct())
    held = ranked_within(held, "line", [F.col("doc").asc_nulls_first()], "held").select("line", "doc", F.col("rank_in_group").alias("rank"))
    held = written(held, "ranked")
    low = 2
    alive = written(alive.join(held, ["line", "doc"]).filter(F.col("rank") > low), "alive")
    while not alive.isEmpty():
        high = low * GROWTH
        tries = held.filter(F.col("rank").between(low, high - 1)).select("line", F.col("doc").alias("first"), F.col("rank").alias("r"))
        pairs = written(alive.join(tries, "line").filter(F.col("r") < F.col("rank")).select("doc", "first").distinct(), "pairs")
        few = own
        if pairs.count() <= MOST_BROADCAST:
            ids = pairs.select("doc").union(pairs.select("first")).distinct()
            few = written(own.join(F.broadcast(ids), "doc", "left_semi"), "few")
        gone = written(merged(gone.union(lost(pairs, few))), "gone")
        low = high
        alive = written(surviving(alive.filter(F.col("rank") > low), gone), "alive")
    return gone


def dedup(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with cleaned ``text`` and an array column ``_gone`` (``_gone_`` if taken) of the indices of the lines that were removed.

    A text that loses every line becomes empty. Null texts stay null, wordless lines stay. Rows
    that repeat doc_id and text lose the same lines, so they are never copies of each other. Texts
    are read whole, whatever their length; an empty table gives no rows.
    """
    found = removals(docs, **how).select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t"), "gone")
    marked = packed(docs, "doc_id", "text").withColumn("text_id", text_key(F.col("text")))
    joined = marked.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_id") == F.col("_t")), "left")
    kept = F.filter(lines(F.col("text")), lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    cells = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return joined.select(*cells, F.coalesce("gone", F.array().cast("array<int>")).alias(spare_name(docs, "_gone")))


def query(docs: DataFrame) -> DataFrame:
    found = dedup(docs.select("doc_id", "text", lines(F.col("text")).alias("_lines")), every=True)
    return found.select(
        "doc_id",
        (F.size("_lines") - F.size("_gone")).cast("long").alias("n_lines_kept"),
        F.size("_gone").cast("long").alias("n_lines_removed"),
        F.array_join("_gone", ",").alias("lines_removed"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
