"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, neardup, sharding, toxicity
from tessera.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of this score or more go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of TOXIC or more go; the scorer learns from the labels of the documents at hand, without the held-out third.

    Null, empty and letterless texts score 0 and stay, as does everything where no label is toxic.
    """
    docs = docs.select(*COLUMNS)
    model, scorer = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, scorer).filter(F.col("_toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the row of the least doc_id stays; null texts stay, of repeated rows one does."""
    return neardup.keep_first(docs).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; null, empty and wordless ones have none and stay."""
    return decontam.drop_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as many times as the mix takes it."""
    return mixing.mix(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: doc_id, size, shard and slot. Rows of equal texts share a shard, null is an empty text."""
    return sharding.query(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the scorer or the near-duplicate classes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder."""
    at = f"{shared_dir(spark)}/tessera-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
