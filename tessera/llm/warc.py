"""WARC archives through a chunked record table.

A payload larger than ``chunk_bytes`` is rows of (record id, chunk number); writer and reader handle
one chunk at a time, with the SHA-256 carried from chunk to chunk, so no Python process ever holds a
whole record. Writers put one gzip member per record into files of the shared folder; a file counts
only when its task's manifest row was committed, so lost or repeated tasks do no harm.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest id is
a ``response`` and the others are ``revisit`` records that refer to it.

Edge cases: a null payload is empty; a null url has no target URI; a null id is kept as null (and
never the one referred to, unless all are null); rows that repeat the smallest id and its payload are
all responses; an empty table gives no archive and no row; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, table, written

CHUNK_BYTES = 256 << 10
MIN_REVISIT_BYTES = 100
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CHUNK_SCHEMA = "record_id long, target_uri string, record_type string, refers_to long, chunk_no int, payload binary, bytes_so_far long, digest_so_far string, is_last boolean"


def record_table(df: DataFrame, record_id: str, url: str, payload: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record_id, target_uri, body, n_bytes, digest, refers_to); refers_to is null for responses."""
    text = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(url).alias("target_uri"), text.alias("body"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"))
    small = rows.where(F.col("n_bytes") >= min_revisit_bytes).select("record_id", "digest")
    firsts = small.groupBy("digest").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = small.distinct().join(firsts, "digest").where("first is not null and not (record_id <=> first)").select(F.col("record_id").alias("_id"), F.col("digest").alias("_d"), "first")
    return rows.join(revisits, F.col("record_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d")), "left").drop("_id", "_d").withColumnRenamed("first", "refers_to")


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of one chunk each, a record's in order and next to one another; revisits have one empty chunk."""
    body = F.when(F.col("refers_to").isNull(), F.encode("body", "UTF-8")).otherwise(F.lit(b""))
    last = F.when(F.col("refers_to").isNull(), F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / chunk_bytes)).otherwise(F.lit(0)).cast("int")
    rows = records.withColumn("body", body).withColumn("last_no", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last_no"))))
    return rows.withColumn("body", F.substring(F.col("body"), F.col("chunk_no") * F.lit(chunk_bytes) + F.lit(1), F.lit(chunk_bytes)))


def _uri(path: str, spark: SparkSession) -> str:
    """Path with its scheme, as pyarrow's file systems want it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _head(row: dict) -> bytes:
    urn = lambda x: f"<urn:page:{'' if x is None else x}>"
    revisit = row["refers_to"] is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(row['record_id'])}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in row["target_uri"]))
    if revisit:
        head += [f"WARC-Refers-To: {urn(row['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['n_bytes']}"]
    head.append(f"Content-Length: {len(HTTP_HEAD) + (0 if revisit else row['n_bytes'])}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + HTTP_HEAD


def write_archives(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the chunk rows of each partition to one archive; the manifest (uri, n_records), committed."""
    spark = chunks.sparkSession
    folder = _uri(folder, spark)
    meta = ["record_id", "target_uri", "refers_to", "n_bytes", "digest", "chunk_no", "last_no"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = pafs.FileSystem.from_uri(folder)
        uri = out = packer = None
        n = 0
        for batch in batches:
            rows, bodies = batch.select(meta).to_pylist(), batch.column("body")
            for row, body in zip(rows, bodies):
                if out is None:
                    files.create_dir(where, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    uri, out = f"{folder}/{name}", files.open_output_stream(f"{where}/{name}", compression=None)
                if row["chunk_no"] == 0:
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(row)))
                out.write(packer.compress(body.as_buffer()))
                if row["chunk_no"] == row["last_no"]:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": pa.array([n], pa.int64())})

    return written(chunks.select(*meta, "body").mapInArrow(write, "uri string, n_records long"), "warc-manifest")


def _records(stream, chunk_bytes: int, payloads: bool) -> Iterator[tuple]:
    """Chunk rows of one archive, as in CHUNK_SCHEMA."""
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        left = int(head["content-length"])
        while (line := stream.readline()) not in (b"\r\n", b""):
            left -= len(line)
        left -= 2
        me = (number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"])
        stated = head["warc-payload-digest"].removeprefix("sha256:")
        if head["warc-type"] == "revisit":
            yield (*me, number(head["warc-refers-to"]), 0, b"" if payloads else None, int(head["x-payload-length"]), stated, True)
        else:
            digest, done, no = hashlib.sha256(), 0, 0
            while True:
                piece = stream.read(min(chunk_bytes, left))
                if len(piece) < min(chunk_bytes, left):
                    raise ValueError(f"archive ends within record {me[0]}")
                left -= len(piece)
                done += len(piece)
                digest.update(piece)
                hexed = digest.copy().hexdigest()
                if left == 0 and hexed != stated:
                    raise ValueError(f"digest of record {me[0]} is {hexed}, not {stated}")
                yield (*me, None, no, piece if payloads else None, done, hexed, left == 0)
                no += 1
                if left == 0:
                    break
        stream.read(4)


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives that a manifest lists."""
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                files, where = pafs.FileSystem.from_uri(uri)
                with files.open_input_stream(where, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="rb") as stream:
                    rows, held = [], 0
                    for row in _records(stream, chunk_bytes, payloads):
                        rows.append(row)
                        held += len(row[5] or b"")
                        if held >= 8 << 20 or len(rows) >= 4096:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return manifest.select("uri").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(read, CHUNK_SCHEMA)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(chunked(record_table(pages, "page_id", "url", "html")), new_path(spark, "warc"))
    last = read_chunks(manifest, payloads=False).where("is_last")
    return last.select(F.col("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
