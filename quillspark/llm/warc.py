"""WARC archives: writing captures, reading records back and assembling transactions.

A capture is written as three WARC/1.1 records: a response (or a revisit, where an equal
payload is stored elsewhere), the request and metadata. The latter two name the first in
WARC-Concurrent-To. Each record is a gzip member of its own, so any record can be read from
its offset alone, and files end after ``FILE_BYTES``, whatever the number of captures.

Executors write files under names of their own and report them; a table of the files of
tasks that succeeded is stored beside them, and readers take the files that it lists. What a
lost executor has left is never read. Readers stream each file, inflate member by member
and cut records by Content-Length, so payloads may hold anything, record headers included.

Defined results: a null html is an empty payload; a null url is stored as an empty
target. Null page ids are larger than none: they never are the stored copy unless all are
null. Rows that repeat the largest page id of their payload are all responses. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.runtime import map_arrow, materialise, new_path, read_table

#: Smaller payloads are always stored: a revisit record would save nothing.
LEAST_REVISIT = 1000
#: Bytes from which on a file is full.
FILE_BYTES = 64 << 20
#: Stands in for the crawl time, which ``pages`` doesn't have.
DATE = "2024-01-01T00:00:00Z"

#: Of zlib.
LEVEL = 6

RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_bytes long, payload_digest string, fields string"


FILES = "file string, bytes long, captures long"


def _record(kind: str, ident: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    told = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in told) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def _capture(page: int | None, url: str, html: bytes, stored: int | None) -> bytes:
    """The three records of a capture; ``stored`` is the page that holds an equal payload."""
    digest = hashlib.sha1(html).hexdigest()
    urn = lambda p, role: f"urn:x-page:{'null' if p is None else p}:{role}:{digest}"
    uri = url.replace("\r", "").replace("\n", "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if stored is None:
        first = _record("response", urn(page, "capture"), common, http + html)
    else:
        first = _record("revisit", urn(page, "capture"), [*common, ("WARC-Refers-To", f"<{urn(stored, 'capture')}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], http)
    concurrent = [("WARC-Target-URI", uri), ("WARC-Concurrent-To", f"<{urn(page, 'capture')}>")]
    _, there, rest = uri.partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if there else ""
    asked = f"GET {rest[len(host) :] if there else uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    request = _record("request", urn(page, "request"), [*concurrent, ("Content-Type", "application/http; msgtype=request")], asked)
    about = f"page-id: {'' if page is None else page}\r\n".encode()
    return first + request + _record("metadata", urn(page, "metadata"), [*concurrent, ("Content-Type", "application/warc-fields")], about)


def _written(batches, path: str, full: int):
    """Writes captures to files of its own and yields a row for each."""
    system, place = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    out, name, size, captures = None, "", 0, 0

    def closed():
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([captures], pa.int64())], names=["file", "bytes", "captures"])

    for batch in batches:
        for page, url, html, stored in zip(*(batch.column(c) for c in ("page_id", "url", "html", "stored")), strict=True):
            if out is None:
                name, size, captures = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                system.create_dir(place, recursive=True)
                out = system.open_output_stream(f"{place}/{name}", compression=None)
            told = _capture(page.as_py(), url.as_py(), html.as_buffer().to_pybytes(), stored.as_py())
            out.write(told)
            size, captures = size + len(told), captures + 1
            if size >= full:
                yield closed()
                out = None
    if out is not None:
        yield closed()


def write_captures(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Writes all pages (page_id, url, html) as captures; of equal payloads only one is stored."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digest, size = F.sha1(F.col("html").cast("binary")), F.octet_length("html")
    slim = pages.select("page_id", digest.alias("digest"), size.alias("size")).where(F.col("size") >= least_revisit)
    stored = slim.groupBy("digest", "size").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).where("n > 1 and stored is not null")
    again = slim.join(stored, ["digest", "size"]).where("page_id is null or page_id <> stored").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "stored").distinct()
    again = materialise(again, "revisits")
    rows = pages.withColumn("digest", digest)
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["_page"]) & (rows["digest"] == again["_digest"]), "left")
    rows = rows.select("page_id", "url", F.col("html").cast("binary").alias("html"), "stored")
    map_arrow(rows, partial(_written, path=path, full=file_bytes), FILES).write.parquet(f"{path}/files.parquet")


def records(stream: io.BufferedIOBase):
    """(headers by lower-case name, block) of each record of a WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the file ends within a record")
        yield headers, block


def _parsed(batches, path: str, with_payload: bool):
    system, place = fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for name in batch.column("file").to_pylist():
            stream = io.BufferedReader(gzip.GzipFile(fileobj=system.open_input_stream(f"{place}/{name}", compression=None)), 1 << 20)
            rows, held = [], 0
            for h, block in records(stream):
                kind, size, digest, fields, payload = h["warc-type"], None, None, None, None
                if kind in ("response", "revisit"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if h.get("warc-payload-digest", f"sha1:{digest}").removeprefix("sha1:") != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
                    else:  # the HTTP headers and the digest still describe the full payload
                        size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        digest, payload = h["warc-payload-digest"].removeprefix("sha1:"), None
                else:
                    fields = block.decode()
                row = [h["warc-record-id"].strip("<>"), kind, *(h[k].strip("<>") if k in h else None for k in ("warc-concurrent-to", "warc-refers-to")), h.get("warc-target-uri"), size, digest, fields]
                rows.append([*row, payload] if with_payload else row)
                held += len(block) if with_payload else 500
                if held > 4 << 20:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """All records of the archives under ``path``, a file a task."""
    files = spark.read.schema(FILES).parquet(f"{path}/files.parquet")
    files = files.select("file").repartition(max(1, files.count()), "file")
    return map_arrow(files, partial(_parsed, path=path, with_payload=with_payload), RECORD + ", payload binary" * with_payload)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata."""
    sides = {}
    for kind in ("request", "metadata"):
        own = rows.where(F.col("type") == kind).dropDuplicates(["concurrent_to"])
        sides[kind] = own.select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "fields").alias(kind))
    captures = rows.where(F.col("type").isin("response", "revisit"))
    captures = captures.select("record_id", F.struct(*(c for c in rows.columns if c not in ("record_id", "concurrent_to", "fields"))).alias("response"))
    return captures.join(sides["request"], "record_id", "left").join(sides["metadata"], "record_id", "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_captures(read_table(spark, sf_dir, "pages"), path)
    captures = assemble(materialise(read_records(spark, path), "records"))  # parsed once
    page = F.regexp_extract("metadata.fields", r"page-id: (-?[0-9]+)", 1)
    refers = F.regexp_extract("response.refers_to", r"^urn:x-page:(-?[0-9]+):", 1)
    return captures.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
s AS (SELECT d, n, max(page_id) AS m FROM p WHERE n >= {LEAST_REVISIT} GROUP BY 1, 2)
SELECT page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN s USING (d, n)
"""
