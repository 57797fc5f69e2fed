"""Deterministic sharded WARC writer and reader.

Every page row is a record. Records are range-sorted by page_id; each range writes its own series of files, and a file ends with the record at
which its compressed size reaches `roll_bytes`. Every record is a gzip member of its own with headers and digests
made anew: the record id is a UUID from the digest of its identity, dates are fixed by the caller, so equal input and
ranges give equal files. A file is written under a temporary name with the attempt in it and moved to its final name
when complete; tasks return manifest rows, and the manifest, written last under a temporary name and moved, is what
makes a run visible: readers take the files that it lists, with their sizes and digests, and nothing else.

Of records with equal payloads of at least `min_revisit` bytes, the first (that with the smallest page_id) is a response
and the others revisit it: their block is the HTTP header only (with the payload's length), their digest that of the payload.

Files are written through pyarrow's file systems, at a URI in the folder that the cluster shares.

Skew: equal payloads are met by their digests only, pre-aggregated; html is shuffled once, by ranges of page_id, where
the note that a page is a revisit joins it as a neighbouring row.

Defined cases: null html is an empty payload, and very long html is written whole; null urls are written as an empty
target. Where page_ids repeat or are null, rows are ordered by (page_id, null ids last; digests of url and html) and
numbered; each row, equal ones too, is a record of its own, and the first in that order is the response. A row without a
page_id is read back without one (and so is refers_to of what revisits it). An empty table makes a manifest without
files; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._base import fresh_path, numbered, partitions, stored, table

NAME = "op5_warc"
ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_PARSED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"
_MANIFEST = "file string, bytes long, records long, sha256 string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(number: tuple[int, int]) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'page:%d' % number[0] + (b':%d' % number[1] if number[1] > 1 else b'')).digest()[:16], version=5)}>"


def record(number: tuple[int, int], page_id: int | None, url: str, payload: bytes, refers_to: tuple[tuple[int, int], int | None] | None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed. number: of the row, and which of its copies this is; refers_to: number and page_id
    of the response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base32_sha1(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(number)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        if refers_to[1] is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to[1]}")
        lines += [f"WARC-Refers-To: {_record_id(refers_to[0])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Series:
    """The files of one range: temporary name while written, final name when complete."""

    def __init__(self, root: str, prefix: str, roll_bytes: int, attempt: str):
        self.store, self.root = _open(root)
        self.prefix, self.roll, self.attempt = prefix, roll_bytes, attempt
        self.number, self.out = 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"{self.prefix}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{self.name}-{self.attempt}"
            self.out, self.size, self.records, self.digest = self.store.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.digest.update(data)
        self.size, self.records = self.size + len(data), self.records + 1
        if self.size >= self.roll:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.out, self.number = None, self.number + 1
        self.store.move(self.temporary, f"{self.root}/{self.name}")
        return self.name, self.size, self.records, self.digest.hexdigest()


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "bytes", "records", "sha256"])


def _write(root: str, roll_bytes: int, date: str):
    def run(batches):
        from pyspark import TaskContext

        context, series, rows, note = TaskContext.get(), None, [], None
        for batch in batches:
            numbers, copies, kinds, firsts, own, ids, urls, pages = (batch.column(i) for i in range(8))
            for i, number in enumerate(zip(numbers.to_pylist(), copies.to_pylist(), strict=True)):
                if kinds[i].as_py() == 0:  # the note comes before its page
                    note = (number, (firsts[i].as_py(), 1), own[i].as_py())
                    continue
                if series is None:
                    series = _Series(root, f"part-{context.partitionId():05d}", roll_bytes, f"{context.taskAttemptId()}")
                to = note[1:] if note and note[0] == number else None
                rows += series.add(_member(record(number, ids[i].as_py(), urls[i].as_py() or "", (pages[i].as_py() or "").encode(), to, date)))
        if series is not None and series.out is not None:
            rows.append(series.close())
        yield _manifest_batch(rows)

    return run


def write_warc(pages: DataFrame, root: str, min_revisit: int = 0, roll_bytes: int = ROLL_BYTES, ranges: int | None = None, date: str = DATE) -> str:
    """Writes pages(page_id, url, html) under the URI root; returns the URI of the manifest (JSON lines)."""
    spark = pages.sparkSession
    store, path = _open(root)
    store.create_dir(path, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages, own = numbered(pages, key="page_id", payload=("html", "url"))
    if own:
        pages = pages.withColumn("copy", F.lit(1).cast("long"))
    else:  # equal rows become one, and then so many copies
        pages = pages.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("html").alias("html"), F.count(F.lit(1)).alias("n"))
        pages = pages.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    slim = stored(pages.select("row", "copy", "page_id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").alias("n")), "payloads").where(F.col("n") >= min_revisit)
    firsts = slim.groupBy("digest").agg(F.min(F.struct("row", "copy", "page_id")).alias("first"), F.count(F.lit(1)).alias("records")).where("records > 1")
    # Of equal rows the first copy is the least, so a response has copy 1.
    later = slim.join(firsts, "digest").where("row > first.row or copy > first.copy")
    nothing = F.lit(None).cast("string")
    notes = later.select("row", "copy", F.lit(0).alias("kind"), F.col("first.row").alias("first"), F.col("first.page_id").alias("own"), F.lit(None).cast("bigint").alias("page_id"), nothing.alias("url"), nothing.alias("html"))
    rows = pages.select("row", "copy", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("own"), "page_id", "url", "html")
    ranged = rows.unionByName(notes).repartitionByRange(ranges or partitions(spark), "row", "copy").sortWithinPartitions("row", "copy", "kind")
    written = ranged.mapInArrow(_write(root, roll_bytes, date), _MANIFEST).orderBy("file").collect()  # a row a file
    temporary = f"{path}/_temporary-manifest-{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write("".join(json.dumps(r.asDict()) + "\n" for r in written).encode())
    store.move(temporary, f"{path}/manifest.jsonl")
    return f"{root}/manifest.jsonl"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of an uncompressed WARC stream."""
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {}
        while (line := stream.readline().strip()):
            key, _, value = line.decode().partition(":")
            headers[key] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]):
            raise ValueError("a record is cut short")
        yield headers, block


def _read(root: str, payload: bool):
    def run(batches):
        store, path = _open(root)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{path}/{file}", compression=None) as raw, gzip.open(raw) as stream:
                    for k, (headers, block) in enumerate(parse(stream)):
                        head, _, body = block.partition(b"\r\n\r\n")
                        if "sha1:" + base32_sha1(block) != headers["WARC-Block-Digest"]:
                            raise ValueError(f"block digest of record {k} in {file}")
                        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (base32_sha1(body) != digest or len(body) != int(fields["Content-Length"])):
                            raise ValueError(f"payload of record {k} in {file}")
                        to = headers.get("X-Refers-To-Page-ID")
                        page = headers.get("X-Page-ID")
                        rows.append((int(page) if page else None, headers["WARC-Target-URI"], int(fields["Content-Length"]), digest, headers["WARC-Type"], int(to) if to else None, file, k, body if payload else None))
                        if len(rows) >= 1000:
                            yield _parsed(rows, payload)
                            rows = []
                yield _parsed(rows, payload)

    return run


def _parsed(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"] + ["payload"] * payload
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def read_warc(spark: SparkSession, manifest: str, payload: bool = False) -> DataFrame:
    """A row per record of the files that the manifest lists; digests are checked. payload: with the bytes (empty for
    revisits)."""
    root = manifest.rpartition("/")[0]
    store, path = _open(manifest)
    with store.open_input_stream(path) as lines:
        files = [json.loads(x)["file"] for x in lines.read().decode().splitlines()]
    if not files:
        return spark.createDataFrame([], _PARSED + ", payload binary" * payload)
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files), "file")
    return listed.mapInArrow(_read(root, payload), _PARSED + ", payload binary" * payload)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_warc(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 from the digest's bits, five at a time.
ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits,
  min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda k: substr(bits, i * 5 + k + 1, 1)::INT * (16 >> k)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
