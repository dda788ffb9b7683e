"""WARC archives: write one record per page, keep an index, read records back by byte ranges.

Writing: pages are dealt to tasks; a task appends gzip members, one per record, to archive files of
bounded size in the shared folder and returns an index row (file, offset, length, url, digest) for
each record. The index table is the commit point: an archive left by a task that was lost or run
twice is in no index row, and every attempt writes files of its own name.

Reading: index rows are dealt by file and stretch of the file, sorted by offset; records that lie
close together are fetched by one read of bounded size, then cut apart and checked.

Records with equal payloads of at least `least` bytes are one response, that of the least page_id,
and revisits that refer to it and carry no payload of their own.

Defined results: a null html is an empty payload; rows that repeat the least page_id are all
responses; a null page_id counts as no page, and its record revisits another page's or is a response;
null urls are written as urn:page:<id>; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written

LEAST = 0
FILE_BYTES = 64 << 20
READ_BYTES = 4 << 20
TASK_BYTES = 4 << 20  # of archives, for each reading task
GAP_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, sha1: str, refers_to) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit if it refers to another page's record."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or f'urn:page:{page_id}').split())}", f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}",
        ]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n", 4, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member; the payload's digest is checked where it is there."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    if rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and digest(payload) != sha1:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page = lambda value: None if value is None or value.endswith(":None>") else int(value.rpartition(":")[2].rstrip(">"))
    return {
        "page_id": page(fields["WARC-Record-ID"]), "payload_bytes": int(fields.get("X-Payload-Length", len(payload))),
        "payload_digest": sha1, "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")),
        "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def first_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(sha1, first): the least page_id of each payload that several rows of pages have."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = pages.select("page_id", F.sha1(body).alias("sha1"), F.octet_length(body).alias("n"))
    shared = digests.filter(F.col("n") >= least).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count("*").alias("rows")
    )
    return written(shared.filter("rows > 1 AND first IS NOT NULL").drop("rows"), "shared")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives under folder and returns their index, a table of the shared folder."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # `shared` is a written table: a payload that very many pages have is split by the adaptive join
    rows = (
        pages.select("page_id", "url", body.alias("payload")).withColumn("sha1", F.sha1("payload"))
        .join(first_pages(pages, least), "sha1", "left")
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    )
    index = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(_writer(folder, file_bytes), INDEX)
    return written(index, "index")


def opened(folder: str):
    """The file system of a folder and the path in it; Spark's names of S3 are one to Arrow."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))


def _writer(folder: str, file_bytes: int):
    def run(batches):
        where, base = opened(folder)
        where.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                sha1 = digest(row["payload"])
                data = record_bytes(row["page_id"], row["url"], row["payload"], sha1, row["refers_to"])
                out.write(data)
                kind = "response" if row["refers_to"] is None else "revisit"
                found.append((row["page_id"], row["url"], sha1, kind, row["refers_to"], name, at, len(data)))
                at += len(data)
            yield _batch(found, INDEX)
        if out is not None:
            out.close()

    return run


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[part.split() for part in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def read_records(index: DataFrame, folder: str, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that the index rows name, fetched by sorted and coalesced byte ranges."""
    stretch = F.floor(F.col("offset") / read_bytes).alias("stretch")
    # a number given, adaptive execution does not merge the partitions by the bytes of the small index rows
    tasks = (index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + 1
    dealt = (
        index.select("file", "offset", "length", stretch).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    )
    return dealt.drop("stretch").mapInArrow(_reader(folder, read_bytes, gap_bytes), RECORD)


def _reader(folder: str, read_bytes: int, gap_bytes: int):
    def run(batches):
        where, base = opened(folder)
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True))
            for file, ranges in coalesced(rows, read_bytes, gap_bytes):
                start, end = ranges[0][0], ranges[-1][0] + ranges[-1][1]
                with where.open_input_file(f"{base}/{file}") as source:
                    source.seek(start)
                    data = memoryview(source.read(end - start))
                records = [parse_record(bytes(data[o - start : o - start + n])) for o, n in ranges]
                yield _batch([tuple(r[c.split()[0]] for c in RECORD.split(", ")) for r in records], RECORD)

    return run


def coalesced(rows, read_bytes: int, gap_bytes: int):
    """Sorted (file, offset, length) rows as (file, [(offset, length)...]) of one read each."""
    file, ranges = None, []
    for name, offset, length in rows:
        near = ranges and offset - ranges[-1][0] - ranges[-1][1] <= gap_bytes and offset + length - ranges[0][0] <= read_bytes
        if ranges and (name != file or not near):
            yield file, ranges
            ranges = []
        file = name
        ranges.append((offset, length))
    if ranges:
        yield file, ranges


def query(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
