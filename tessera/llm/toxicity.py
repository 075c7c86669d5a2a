"""Toxicity by a noisy channel: obfuscated spellings are decoded under a character model, then a logistic regression scores the restored text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import exp, fsum, log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, spare_name, written

#: Labelled documents per class that the scorer is fitted on at most, by least hash of doc_id.
TRAIN_DOCS = 6000
#: A feature is a whole word or a beginning of so many letters that LEAST kinds of documents of the sample have.
BEGINNINGS, LEAST = (4, 5, 6), 3
#: Chance that any feature that has nothing to do with the label is taken for significant (Chernoff's bound, divided by the features seen).
ACCIDENT = 0.05
#: Ridge penalties, in documents, of features of significance and of all others; steps of the fit.
SURE, UNSURE, STEPS = 0.02, 30.0, 100
#: Words whose features a scorer keeps at hand.
MOST_WORDS = 300_000
#: Words of the runs by whose least hash copies and near copies are told.
KIND = 5
#: Documents whose features a step of the fit goes through at once.
ROWS_AT_ONCE = 256
#: One kind of document in so many is left out of the fit, and calibrates its scores.
CALIBRATION = 5

#: Costs of the channel, in nats: reading a sign as a letter, as a gap, dropping a sign, dropping a gap, one letter of a run.
READ, GAP, DROP, JOIN, RUN = 0.5, 4.0, 9.0, 0.3, 0.5
#: Dropping a gap between pieces that aren't single letters, one of two equal letters, and a sign at the edge of a word.
CHUNK, DOUBLE, EDGE = 5.0, 6.0, 8.0

# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}

#: Signs that end or begin words as punctuation, too; dropping them there costs nothing.
_PUNCTUATION = "!(|"
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET)
#: Three or more of a sign at the edge of a word are no letter.
_JUNK = re.compile(r"^([\W\d_])\1\1+|([\W\d_])\2\2+$")
_RUN = re.compile(r"([^\W\d_])\1\1|([^\W\d_])\2([^\W\d_])\3")
_DOUBLED = re.compile(r"([^\W\d_])\1")
#: Tokens of so many characters may be chunks of one word.
SHORT = 3
#: Longer spans aren't kept in the cache.
MOST_KEPT = 40
_NOT_LETTERS = re.compile(r"[\W\d_]+")

#: Letters of the character model: 0 a boundary, 1-26 a-z, 27 any other letter.
SIZE = 28
_CODES = np.zeros(0x250, dtype=np.int64)
for _c in range(0x250):
    _CODES[_c] = ord(chr(_c)) - 96 if "a" <= chr(_c) <= "z" else 27 if chr(_c).isalpha() else 0


def codes(text: str) -> np.ndarray:
    """Model letters of a text that is lower-cased; a run of others is one boundary."""
    raw = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32)
    found = np.where(raw < 0x250, _CODES[np.minimum(raw, 0x24F)], 27)
    return found[~((found == 0) & (np.roll(found, 1) == 0))]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, dtype=np.int64)
    for batch in batches:
        for text in batch.column("text"):
            c = codes((text.as_py() or "").lower())
            if len(c) > 2:
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
    (at,) = total.nonzero()
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs [a, b, c] of a letter after two others, counted over every text; a table of fixed size."""
    rows = docs.select("text").mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    tri = counts.reshape(SIZE, SIZE, SIZE)
    bi = tri.sum(axis=0)
    one = (bi.sum(axis=0) + 1) / (bi.sum() + SIZE)
    two = (bi + 5 * one) / (bi.sum(axis=1, keepdims=True) + 5)
    return -np.log((tri + 5 * two[None]) / (tri.sum(axis=2, keepdims=True) + 5))


def _gap(c: str) -> bool:
    return not c.isalpha() and c not in LEET


def _singles(span: str) -> list[bool]:
    """For each run of separators inside a span, whether it lies between single signs, three in a row at least."""
    pieces = "".join(" " if _gap(c) else c for c in span).split()
    alone, at = [False] * len(pieces), 0
    while at < len(pieces):
        end = at
        while end < len(pieces) and len(set(pieces[end])) == 1 and len(pieces[end]) < 3:
            end += 1
        if end - at >= 3:
            alone[at:end] = [True] * (end - at)
        at = max(end, at + 1)
    return [x and y for x, y in zip(alone, alone[1:], strict=False)]


def _lattice(span: str) -> list[list[tuple[str, float]]]:
    """Readings of each place of a span: (what it stands for, cost); a blank stands for a boundary."""
    singles = iter(_singles(span))
    places, at = [], 0
    while at < len(span):
        c = span[at]
        run = at + 1
        if _gap(c):
            while run < len(span) and _gap(span[run]):
                run += 1
            if at == 0 or run == len(span):
                places.append([(" ", 0.0)])
            else:
                places.append([("", JOIN), (" ", GAP)] if next(singles) else [(" ", 0.0), ("", CHUNK)])
            at = run
            continue
        while run < len(span) and span[run] == c:
            run += 1
        if c in LEET:
            drop = DROP
            if at == 0 or run == len(span) or " " in (span[at - 1], span[run]):
                drop = 0.0 if c in _PUNCTUATION else EDGE
            reads = [(x, READ) for x in LEET[c]] + [("", drop), (" ", GAP)]
            places += [reads] * min(run - at, 2) if run - at < 3 else [reads + [("", READ)]]
        elif run - at == 2:
            places.append([(c + c, 0.0), (c, DOUBLE)])
        else:
            places.append([(c, 0.0)] if run - at < 3 else [(c, RUN), (c + c, 2 * RUN)])
        at = run
    return places


def decode(span: str, costs: list) -> str:
    """The best path through the lattice (Viterbi over the last two letters), read out as text."""
    states = {(0, 0): (0.0, None)}
    for readings in [*_lattice(span), [(" ", 0.0)]]:
        following: dict[tuple[int, int], tuple] = {}
        for (a, b), (cost, path) in states.items():
            for letters, more in readings:
                x, y, total = a, b, cost + more
                for c in letters:
                    z = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
                    if z or y:
                        total += costs[x][y][z]
                        x, y = y, z
                best = following.get((x, y))
                if best is None or total < best[0]:
                    following[x, y] = (total, (path, letters))
        states = following
    path, found = min(states.values(), key=lambda s: s[0])[1], []
    while path:
        path, letters = path
        found.append(letters)
    return "".join(reversed(found))


class Restorer(dict):
    """Restored text: lower-cased, obfuscated spellings decoded, all else but letters one space, framed by spaces.

    It is a cache of tokens and of spans of them, emptied when full. A token has one reading
    only, and so needs no decoding, if punctuation merely surrounds its letters and no letter is
    repeated against the character model. Successive tokens are decoded together, blanks, signs
    and runs in one lattice, where a blank may go: between three or more single characters,
    between short tokens whose boundary the model likes less than none, and beside a token with
    signs. Between plain words each boundary depends on two letters of either side only, so
    those are looked up in a table for the whole text at once.
    """

    def __init__(self, model: np.ndarray, most: int = 300_000) -> None:
        super().__init__()
        self.costs, self.most, self.signed = model.tolist(), most, set()
        kept = model[:, :, 0, None] + model[:, 0, :][None] - model
        self.loose = (kept[:, :, :, None] + (model[0][None] - model)[None] > CHUNK).ravel()

    def __missing__(self, span: str) -> str:
        if len(self) >= self.most:
            self.clear()
            self.signed.clear()
        found = self.read(span)
        if len(span) <= MOST_KEPT:
            self[span] = found
        return found

    def read(self, span: str) -> str:
        if " " not in span:
            token, span = span, span.strip(_EDGES)
            if not span.isalpha():
                span = _JUNK.sub("", span).strip(_EDGES)
                if span.rstrip(_PUNCTUATION).isalpha():
                    span = span.rstrip(_PUNCTUATION)
                elif any(c in LEET for c in span) and any(c.isalpha() for c in span):
                    self.signed.add(token)
            if span.isalpha() and not (_DOUBLED.search(span) and (_RUN.search(span) or self.stammers(span))):
                return span
        if not any(c.isalpha() for c in span):
            return ""
        return " ".join(_NOT_LETTERS.sub(" ", decode(span, self.costs)).split())

    def stammers(self, word: str) -> bool:
        """Whether the best path drops one of two equal letters; it depends on their neighbours only, unless those are doubled too."""
        for m in _DOUBLED.finditer(word):
            x, c, y = (ord(z) - 96 if "a" <= z <= "z" else 0 if z == " " else 27 for z in (word[m.start() - 1 : m.start()] or " ", m[1], word[m.end() : m.end() + 1] or " "))
            if self.costs[x][c][c] + self.costs[c][c][y] > self.costs[x][c][y] + DOUBLE:
                return True
        return False

    def spans(self, flat: str, tokens: list[str]) -> list[tuple[int, int]]:
        """Runs of tokens that are decoded together."""
        raw = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)
        blanks = np.concatenate([[-1], np.flatnonzero(raw == 32), [len(raw)]])
        sizes = np.diff(blanks) - 1
        short, single = sizes <= SHORT, sizes == 1
        open_ = np.zeros(len(tokens) + 1, dtype=bool)  # whether the blank before a token may go
        at = 1 + np.flatnonzero(short[:-1] & short[1:] & ~single[:-1] & ~single[1:])
        if len(at):
            where = blanks[at][:, None] + np.array([-2, -1, 1, 2])
            letters = raw[where]
            c = np.where(letters < 0x250, _CODES[np.minimum(letters, 0x24F)], 27)
            index = ((c[:, 0] * SIZE + c[:, 1]) * SIZE + c[:, 2]) * SIZE + c[:, 3]
            open_[at] = (c > 0).all(axis=1) & self.loose[index]
        if self.signed:
            marked = np.fromiter((t in self.signed for t in tokens), dtype=bool, count=len(tokens))
            open_[1:-1] |= (marked[:-1] & (marked | short)[1:]) | (marked[1:] & short[:-1])
        apart = single[:-1] & single[1:]
        run = np.flatnonzero(apart[:-1] & apart[1:])
        open_[run + 1] = True
        open_[run + 2] = True
        found = []
        for k in np.flatnonzero(open_).tolist():
            if found and found[-1][1] == k:
                found[-1] = (found[-1][0], k + 1)
            else:
                found.append((k - 1, k + 1))
        return found

    def __call__(self, text: str) -> str:
        tokens = text.lower().split()
        if not tokens:
            return "  "
        found = [self[t] for t in tokens]
        for i, j in self.spans(" ".join(tokens), tokens):
            found[i] = self[" ".join(tokens[i:j])]
            found[i + 1 : j] = [""] * (j - i - 1)
        return f" {' '.join(filter(None, found))} "


def word_features(word: str) -> list[str]:
    """The whole word, framed by blanks, and its beginnings, after a blank."""
    return [f" {word} ", *[f" {word[:n]}" for n in BEGINNINGS if n <= len(word)]]


def features(restored: str) -> set[str]:
    return {f for w in set(restored.split()) for f in word_features(w)}


class Scorer:
    """A logistic regression on the presence of features; its score is the probability of toxic if both classes were equally frequent."""

    def __init__(self, weights: dict[str, float], bias: float, slope: float = 1.0, offset: float = 0.0) -> None:
        self.index = {f: i for i, f in enumerate(weights)}
        self.values = list(weights.values())
        self.bias, self.slope, self.offset = bias, slope, offset
        self.known: dict[str, list[int]] = {}

    def __call__(self, restored: str) -> float:
        """0 for a text without a letter. The features of a word are looked up once, in a cache that is emptied when full."""
        words = set(restored.split())
        if not words:
            return 0.0
        new = words.difference(self.known)
        if len(self.known) + len(new) > MOST_WORDS:
            self.known.clear()
            new = words
        for w in new:
            self.known[w] = [i for i in map(self.index.get, word_features(w)) if i is not None]
        found = set(chain.from_iterable(map(self.known.__getitem__, words)))
        margin = self.bias + fsum(map(self.values.__getitem__, found))
        return 1 / (1 + exp(-max(-500.0, min(500.0, self.slope * margin + self.offset))))


def _sure(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int, seen: int) -> np.ndarray:
    """Features whose kinds are toxic beyond accident."""
    n, rate = bad + good, n_bad / (n_bad + n_good)
    share = np.clip(bad / n, 1e-12, 1 - 1e-12)
    apart = share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate))
    return (share > rate) & (-n * apart + log(seen) <= log(ACCIDENT))


def regress(rows: list[np.ndarray], toxic: np.ndarray, penalty: np.ndarray, free: np.ndarray, start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on sets of features, beside given margins; both classes weigh a half.

    Only the features that are ``free`` get a weight. Accelerated gradient steps, each coordinate
    with its own bound on the curvature, started anew when they go uphill. Rows are gone through
    in blocks, so nothing as large as all of them is made.
    """
    sizes = np.array([free[r].sum() for r in rows], dtype=np.int64)
    blocks = [(at, at + len(part), np.concatenate(part), np.array([len(r) for r in part])) for at in range(0, len(rows), ROWS_AT_ONCE) if (part := rows[at : at + ROWS_AT_ONCE])]
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))

    def margins(weights: np.ndarray) -> np.ndarray:
        found = start.copy()
        for low, high, columns, lengths in blocks:
            some = np.flatnonzero(lengths)
            if len(some):
                found[low + some] += np.add.reduceat(weights[columns], (np.cumsum(lengths) - lengths)[some])
        return found

    def by_feature(x: np.ndarray) -> np.ndarray:
        found = np.zeros(len(penalty))
        for low, high, columns, lengths in blocks:
            found += np.bincount(columns, weights=np.repeat(x[low:high], lengths), minlength=len(penalty))
        return found

    curve = free / (by_feature(share * (sizes + 1)) / 4 + penalty)
    flat = 1 / max(1e-12, (share * (sizes + 1)).sum() / 4)
    w, bias = np.zeros(len(penalty)), 0.0
    ahead, ahead_bias, turn = w, bias, 1.0
    for _ in range(steps):
        margin = margins(ahead) + ahead_bias
        off = share * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - toxic)
        slope, slope_bias = by_feature(off) + penalty * ahead, off.sum()
        new, new_bias = ahead - curve * slope, ahead_bias - flat * slope_bias
        if (slope * (new - w)).sum() + slope_bias * (new_bias - bias) > 0:
            turn, ahead, ahead_bias = 1.0, new, new_bias
        else:
            following = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
            pull = (turn - 1) / following
            ahead, ahead_bias, turn = new + pull * (new - w), new_bias + pull * (new_bias - bias), following
        w, bias = new, new_bias
    return w, float(bias)


def calibrate(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins log-odds at equal classes (Platt's method); (1, 0) if a class is absent."""
    slope, offset = 1.0, 0.0
    if not toxic.any() or toxic.all():
        return slope, offset
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -500, 500)))
        off, curve = share * (p - toxic), share * p * (1 - p)
        gradient = np.array([(off * margins).sum() + 0.01 * (slope - 1), off.sum()])
        cross = (curve * margins).sum()
        step = np.linalg.solve(np.array([[(curve * margins**2).sum() + 0.01, cross], [cross, curve.sum() + 1e-6]]), gradient)
        slope, offset = slope - float(np.clip(step[0], -1, 1)), offset - float(np.clip(step[1], -1, 1))
    return max(slope, 0.1), offset


def fit(docs: DataFrame, labelled: DataFrame, model: np.ndarray, *, train_docs: int = TRAIN_DOCS) -> Scorer | None:
    """A scorer from ``docs`` and rows (doc_id, toxic), or None if no row is toxic.

    It is fitted on a bounded sample of whole labelled texts, which are restored once: the ids of at
    most ``train_docs`` of each class are broadcast, so no text is shuffled. Documents that
    share the least hash of their runs of KIND words are one kind, of which one is used, so that
    copies and near copies count once. Features of toxic kinds beyond accident are hardly penalised,
    all others heavily, so those grade the scores without deciding them.
    """
    known = labelled.filter(F.col("toxic").isNotNull())
    drawn = [known.filter(F.col("toxic") == x).orderBy(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), "doc_id").limit(train_docs) for x in (0, 1)]
    ids = drawn[0].union(drawn[1]).select(F.col("doc_id").alias("_d"), "toxic")
    sample = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_d")).select("toxic", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(sent.value)
        for batch in batches:
            runs = [restore(t).split() for t in batch.column("text").to_pylist()]
            least = [min(crc32(" ".join(ws[i : i + KIND]).encode()) for i in range(max(1, len(ws) - KIND + 1))) for ws in runs]
            words = [sorted(set(ws)) for ws in runs]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(least, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["toxic", "kind", "words"])

    texts = sample.mapInArrow(restored, "toxic int, kind long, words array<string>")
    kinds = written(texts.groupBy("toxic", "kind").agg(F.min("words").alias("words")), "kinds")
    n = {r["toxic"]: r["count"] for r in kinds.groupBy("toxic").count().collect()}
    if not n.get(1):
        return None
    fitted = kinds.filter(F.col("kind") % CALIBRATION != 0) if n[1] >= 2 * CALIBRATION else kinds

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Counter(), Counter()
        for batch in batches:
            for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
                (bad if toxic else good).update(features(" ".join(words)))
        names = list(bad | good)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([side[c] for c in names], pa.int64()) for side in (bad, good)]], names=["feature", "bad", "good"])

    counts = written(fitted.mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "features")
    table = counts.filter(F.col("bad") + F.col("good") >= LEAST).orderBy("feature").toPandas()
    index = {name: i for i, name in enumerate(table["feature"])}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            has = [sorted(at[f] for f in features(" ".join(words)) if f in at) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("kind"), pa.array(has, pa.list_(pa.int32()))], names=["toxic", "kind", "has"])

    rows = kinds.mapInArrow(present, "toxic int, kind long, has array<int>").orderBy("kind", "toxic").toArrow()
    has = rows.column("has").combine_chunks()
    offsets, values = has.offsets.to_numpy(), has.values.to_numpy()
    sets = [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    toxic = rows.column("toxic").to_numpy() == 1
    inside = rows.column("kind").to_numpy() % CALIBRATION != 0 if n[1] >= 2 * CALIBRATION else np.ones(len(toxic), dtype=bool)
    n_bad, n_good = int((toxic & inside).sum()), int((~toxic & inside).sum())
    sure = _sure(table["bad"].to_numpy(dtype=np.float64), table["good"].to_numpy(dtype=np.float64), n_bad, max(1, n_good), counts.count())
    used = [s for s, x in zip(sets, inside, strict=True) if x]
    # The significant features first, until they have settled; the others explain what is left.
    small = np.flatnonzero(sure)
    place = np.zeros(len(sure), dtype=np.int32)
    place[small] = np.arange(len(small))
    few, bias = regress([place[s[sure[s]]] for s in used], toxic[inside], np.full(len(small), SURE / max(1, n_bad)), np.ones(len(small), dtype=bool), np.zeros(len(used)), 10 * STEPS)
    weights = np.zeros(len(sure))
    weights[small] = few
    settled = bias + np.array([weights[s].sum() for s in used])
    more, shift = regress(used, toxic[inside], np.full(len(sure), UNSURE / max(1, n_bad)), ~sure, settled)
    weights, bias = weights + more, bias + shift
    margins = np.array([bias + weights[s].sum() for s, x in zip(sets, inside, strict=True) if not x])
    slope, offset = calibrate(margins, toxic[~inside])
    return Scorer({name: float(weights[i]) for name, i in index.items()}, bias, slope, offset)


def score(docs: DataFrame, model: np.ndarray, scorer: Scorer | None) -> DataFrame:
    """``docs`` with ``_toxicity`` (``_toxicity_`` if taken) in 0 to 1: the scorer's probability for the restored text.

    Null, empty and letterless texts score 0, as does everything without a scorer. Rows are
    scored one by one, so repeated rows and ties are alike; very long texts are read whole. An
    empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model, scorer))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        costs, known = sent.value
        restore = Restorer(costs)
        for batch in texts:
            yield pd.Series([known(restore(text)) if text and known else 0.0 for text in batch], dtype="float64")

    found = packed(docs, "text").select("row", scored(F.col("text")).alias("found"))
    return found.select("row.*", F.col("found").alias(spare_name(docs, "_toxicity")))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Scorer | None]:
    """The character model of all texts, and the scorer of the labelled rows that aren't held out.

    A doc_id that is labelled more than once counts as toxic if any label says so.
    """
    model = character_model(docs)
    marks = labels.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return model, fit(docs.filter(~held_out()), marks, model)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model, scorer = learn(docs, labels)
    found = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, scorer)
    return found.select("doc_id", "held_out", F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.7).cast("int").alias("predicted"))
