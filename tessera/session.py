"""Sessions and the driver's tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import register_functions

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def build_session(name: str = "tessera", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the engine relies on; on a cluster, pass one of your own instead.

    Adaptive execution coalesces shuffle partitions and splits skewed ones, so their number is
    an upper bound that may be generous. ANSI mode stays on.
    """
    cpus = cpus or os.cpu_count() or 1
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.cteRecursionLevelLimit": "10000",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(name).master(f"local[{cpus}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder of the session. A local session without one gets a temporary folder; on a cluster that would break, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that every executor reaches")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the driver's tables and the engine's SQL functions."""
    register_functions(spark)
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
