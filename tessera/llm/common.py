"""Shared pieces of the corpus operators: words, row identity, shared storage and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Separators of words: space and U+0009 to U+000D.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables. Only Spark's reader opens the path, so any store will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach (``spark.checkpoint.dir``).

    Only a local session without that setting, such as a test, gets a temporary folder; on a
    cluster other machines wouldn't see it, so there the setting is demanded.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that every executor reaches")
        configured = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of an executor, and it freezes
    row ids made by ``monotonically_increasing_id``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; null and texts of separators alone have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row.

    A lambda variable is bound to a finished array, whereas a column that is named inside a
    lambda may be inlined by the optimiser and computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """128-bit identity of a text; null and the empty text are told apart."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("n")).cast("binary")))


def spare_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the columns ``names``: no other column can clash with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{n}`").alias(n) for n in names])


def ranked_within(df: DataFrame, group: str, order: list[Column], label: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``rank_in_group``: 1, 2, ... in ``order`` within each value of ``group``.

    No group ever meets in one task: rows are range-partitioned by (group, order), numbered in
    their partition, and each (group, partition) block gets the count of the group's earlier
    blocks, a prefix sum over one small row per block. ``df`` should be narrow. Rows that tie
    in everything are interchangeable. Nulls of ``group`` form a group of their own.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_last(), *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("_mid", F.monotonically_increasing_id()), label)
    dealt = dealt.withColumn("_block", F.shiftright("_mid", 33))
    blocks = dealt.groupBy(F.col(group).alias("_g"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = dealt.join(blocks, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("rank_in_group", F.col("_before") + F.col("_mid") - F.col("_first") + 1).drop("_g", "_b", "_block", "_before", "_first", "_mid")
