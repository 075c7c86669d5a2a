"""Change feeds: a table's history as a stream, and channels that carry messages as files."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.database import Database
from tessera.sources.store import EXPIRES


def change_feed(db: Database, table: str) -> DataFrame:
    """A stream of the changes of a table made WITH HISTORY: each commit's rows come once.

    History files are only ever added, so a file stream over their folders is the feed; the
    checkpoint of the query that reads it remembers how far it came.
    """
    log = f"_history_{table.lower()}"
    schema = db.store.schema(db.manifest["tables"][log])
    return db.spark.readStream.schema(schema).parquet(f"{db.store.root}/data/{log}-*").drop(EXPIRES)


class Channel:
    """LISTEN and NOTIFY through files in a shared folder: messages last, and any process may send or read."""

    def __init__(self, spark: SparkSession, folder: str, name: str) -> None:
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{name}"
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(fs_path)

    def notify(self, message: str) -> None:
        row = self.spark.createDataFrame([(time.time(), uuid.uuid4().hex, message)], "sent double, id string, message string")
        row.coalesce(1).write.mode("append").json(self.path)

    def listen(self, heard: Callable[[str], None], checkpoint: str, **trigger) -> StreamingQuery:
        """Call ``heard`` with each message, in the order sent within a batch."""

        def batch(df: DataFrame, _: int) -> None:
            for row in df.orderBy("sent", "id").toLocalIterator():
                heard(row["message"])

        stream = self.spark.readStream.schema("sent double, id string, message string").json(self.path)
        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def expire_stream(rows: DataFrame, expires: str = EXPIRES) -> DataFrame:
    """Rows of a stream that are still alive when they are read."""
    return rows.filter(F.col(expires).isNull() | (F.col(expires) >= F.unix_timestamp()))
