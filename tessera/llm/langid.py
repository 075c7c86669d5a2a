"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, spare_name

BITS = 15
ORDERS = (1, 2, 3)
#: Expected documents per language that the model is fitted on, drawn by a hash of doc_id.
TRAIN_DOCS = 2000
#: The matrix has a column per language; more than this many are refused rather than broadcast.
MOST_LANGS = 2000
SMOOTHING = 0.5
#: Text is scored in pieces of so many characters, which bounds memory for any length.
PIECE = 1 << 18
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of a text, lower-cased, every run of other characters one space; none without a letter."""
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, plain)):  # number signs such as a half or a Roman eight are no letters
        return
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    most = max(ORDERS)
    for at in range(0, len(codes), PIECE):
        piece = codes[at : at + PIECE + most - 1]
        rolled = np.zeros(len(piece), dtype=np.uint64)
        for n in range(1, most + 1):
            rolled = (rolled[: len(piece) - n + 1] + piece[n - 1 :] + np.uint64(n)) * _MIX
            if n in ORDERS:
                rolled ^= rolled >> np.uint64(29)
                yield (rolled[: max(0, min(PIECE, len(rolled)))] * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, n) of a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            row = total.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            for b in buckets(text.as_py()):
                row += np.bincount(b, minlength=1 << BITS)
    for lang, row in total.items():
        (at,) = row.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, *, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability matrix [bucket, language] of rows (doc_id, text, lang).

    Only a bounded sample of whole texts is read: per language, rows whose hash of doc_id falls
    under the share that gives ``train_docs`` rows on average.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = known.groupBy("lang").count().limit(MOST_LANGS + 1).collect()
    if len(per_lang) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not per_lang:
        return [], np.zeros((1 << BITS, 0), dtype=np.float32)
    share = F.create_map(*[x for r in per_lang for x in (F.lit(r["lang"]), F.lit(train_docs / r["count"]))])
    drawn = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(drawn < F.element_at(share, F.col("lang"))).select("lang", "text")
    rows = sample.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(rows["lang"]))
    if not langs:
        return [], np.zeros((1 << BITS, 0), dtype=np.float32)
    counts = np.full((1 << BITS, len(langs)), SMOOTHING)
    counts[rows["bucket"].to_numpy(), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] += rows["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs`` with a struct column ``_lang`` (``_lang_`` if that is taken): lang_pred and score.

    The score is the posterior under equal priors of a third of the evidence, since each
    character is counted in n-grams of three lengths. Null texts, texts without a letter and an
    unfitted model give ``und`` with score 0; ties go to the first language in code-point order.
    Texts of any length are read whole, in pieces; repeated rows are scored alike; an empty
    table gives no rows.
    """
    langs, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        logs = sent.value
        for batch in texts:
            found = []
            for text in batch:
                seen, total = 0, np.zeros(len(langs))
                if text is not None and langs:
                    for b in buckets(text):
                        total += logs[b].sum(axis=0, dtype=np.float64)
                        seen += len(b)
                if not seen:
                    found.append((UNKNOWN, 0.0))
                    continue
                best = int(total.argmax())
                found.append((langs[best], float(1 / np.exp((total - total[best]) / len(ORDERS)).sum())))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    scored = packed(docs, "text").select("row", score(F.col("text")).alias("found"))
    return scored.select("row.*", F.col("found").alias(spare_name(docs, "_lang")))


def query(docs: DataFrame) -> DataFrame:
    """Learns from rows whose crc32 of doc_id leaves a remainder by 5, scores every row."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")))
    found = identify(rows.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "_lang.lang_pred", "_lang.score")
