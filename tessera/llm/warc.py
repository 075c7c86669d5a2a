"""WARC archives with an index: records are written as gzip members with their offsets, read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import shared_dir

#: Bytes after which an archive is full, and the gap up to which two selected records are read in one go; no read is longer than LONGEST unless a record is.
ARCHIVE_BYTES, GAP, LONGEST = 32 << 20, 1 << 16, 8 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
_END = b"\r\n\r\n"
_INDEXED = ["page_id", "url", "payload_digest", "refers_to"]
_INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of five hex digits are four base32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload_digest, refers_to and the whole WARC record of each row of ``pages``.

    Null html is an empty payload. Of equal payloads of ``least_bytes`` or more, the rows of
    the smallest page_id are responses and the others revisits of it; rows without page_id
    are responses unless a page with an id has their payload. A null url has no header line;
    control characters in a url become percent escapes. Each row is a record, repeated ones too;
    payloads are written whole, whatever their length; other columns are ignored; an empty table
    gives no records.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html.cast("binary")).alias("payload_digest"))
    narrow = rows.filter(F.col("payload_bytes") >= least_bytes).select("payload_digest", "page_id")
    first = narrow.groupBy(F.col("payload_digest").alias("_d")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # Written, so that its size is known: where few payloads repeat, no html is shuffled.
    first.write.parquet(f"{path}/repeated")
    first = pages.sparkSession.read.schema(first.schema).parquet(f"{path}/repeated")
    rows = rows.join(first, F.col("payload_digest") == F.col("_d"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    rows = rows.withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(revisit, F.col("_first")))
    named = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat_ws(
        "",
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", named(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(revisit, line("WARC-Refers-To", named(F.col("refers_to")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select("page_id", "url", "payload_digest", "refers_to", F.concat(head, body).alias("record"))


def write(pages: DataFrame, path: str, *, archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archives under ``path``/archives and return their index, one row per record.

    Each task writes its records one after another, each a gzip member of its own as the format
    advises, to archives of about ``archive_bytes``, and yields where each one lies. Archives of
    an attempt have names of their own, and the index, which Spark commits, names only those of
    the attempts that succeeded; a lost or repeated task leaves an archive that nothing names.
    """
    spark = pages.sparkSession
    folder = f"{path}/archives" if "://" in path or path.startswith("file:") else f"file://{path}/archives"
    folder = re.sub(r"^file:/+", "file:///", folder)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            offsets, lengths, files = [], [], []
            for record in batch.column("record"):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record.as_py().encode() + _END, 5, mtime=0)
                out.write(member)
                files.append(f"{folder}/{name}")
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            placed = [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.RecordBatch.from_arrays([*placed, *[batch.column(c) for c in _INDEXED]], names=["file", "offset", "length", *_INDEXED])
        if out is not None:
            out.close()

    index = records(pages, path, least_bytes).mapInArrow(archive, _INDEX)
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def ranges(index: DataFrame, gap: int = GAP, longest: int = LONGEST) -> DataFrame:
    """(file, start, stop, parts): sorted byte ranges of the index's records; neighbours no more than ``gap`` apart share a range."""
    along = Window.partitionBy("file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    apart = F.coalesce(F.col("offset") - F.lag(end).over(along) > gap, F.lit(True)) | (F.floor(F.col("offset") / longest) != F.lag(F.floor(F.col("offset") / longest)).over(along))
    runs = index.withColumn("_run", F.sum(apart.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file", "_run").agg(F.min("offset").alias("start"), F.max(end).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts")).drop("_run")


_HEADERS = re.compile(rb"(?:^|\r\n)([A-Za-z-]+): ?([^\r\n]*)")
_READ = "file string, offset long, record_type string, page_id long, url string, refers_to long, stated_digest string, payload binary"
_NAMES = [x.split(" ")[0] for x in _READ.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in _READ.split(", ")]


def parse(member: bytes) -> tuple:
    record = gzip.decompress(member)
    head, body = record.split(b"\r\n\r\n", 1)
    fields = {k.decode().lower(): v.decode() for k, v in _HEADERS.findall(head)}
    body = body[: int(fields["content-length"])]
    number = lambda x: int(x.removeprefix("<urn:x-page:").rstrip(">")) if x else None
    return fields["warc-type"], number(fields.get("warc-record-id")), fields.get("warc-target-uri"), number(fields.get("warc-refers-to")), fields["warc-payload-digest"].removeprefix("sha1:"), body


def read(index: DataFrame, gap: int = GAP, longest: int = LONGEST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The records that ``index``, or any selection of it, names, read by byte ranges of the archives."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                store, name = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", x["file"]))
                with store.open_input_file(name) as source:
                    block = source.read_at(x["stop"] - x["start"], x["start"])
                found = [(x["file"], p["offset"], *parse(block[p["offset"] - x["start"] : p["offset"] - x["start"] + p["length"]])) for p in x["parts"]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), _TYPES, strict=True)], names=_NAMES)

    # The index is small beside what it stands for, so ranges are dealt by the bytes to read.
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()["b"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // archive_bytes))
    dealt = ranges(index.select("file", "offset", "length"), gap, longest).repartition(parts, "file", "start")
    return dealt.mapInArrow(fetch, _READ)


def digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def resolve(found: DataFrame) -> DataFrame:
    """Records read, each with payload_bytes and payload_digest of its full payload; a revisit has its response's.

    The digest of a response is computed from the bytes that were read.
    """
    own = found.select("page_id", "record_type", "refers_to", "stated_digest", F.octet_length("payload").cast("long").alias("_bytes"), base32_sha1(F.col("payload")).alias("_digest"))
    full = own.filter(F.col("record_type") == "response").groupBy(F.col("page_id").alias("_p"), F.col("_digest").alias("_key")).agg(F.max("_bytes").alias("_full"))
    joined = own.join(full, (F.col("refers_to") == F.col("_p")) & (F.col("stated_digest") == F.col("_key")), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id",
        F.when(revisit, F.col("_full")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("_key")).otherwise(F.col("_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/tessera-warc-{uuid.uuid4().hex}"
    return resolve(read(write(pages, path)))


ORACLE = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, upper(sha1(encode(coalesce(html, '')))) AS h FROM pages
), d AS (
  SELECT *, octet_length(b)::BIGINT AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1) for i in range(0, 32)], '') AS payload_digest
  FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
