"""Windows over streams of events: watermarks, tumbling, sliding and session windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder of them, as a stream of files."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def windowed(events: DataFrame, window: Column, late: str, keys: list[str]) -> DataFrame:
    """Counts per window and key. In append and update mode rows later than the watermark are dropped, and append mode gives a window once it is closed; complete mode keeps all."""
    found = events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), *keys, "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its result table, which is written to the shared folder."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def put(rows: DataFrame, batch: int) -> None:
        """A batch that is tried again writes its own folder anew; a complete result replaces the one before."""
        rows.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)


def tumbling(spark: SparkSession, sf_dir: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per window and type over the whole table; ``ts`` has no zone and is read as UTC."""
    events = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = drain(windowed(events, F.window("ts", length), late, ["event_type"]))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def sliding(events: DataFrame, length: str, step: str, late: str, keys: list[str]) -> DataFrame:
    return windowed(events, F.window("ts", length, step), late, keys)


def sessions(events: DataFrame, gap: str, late: str, keys: list[str]) -> DataFrame:
    return windowed(events, F.session_window("ts", gap), late, keys)
