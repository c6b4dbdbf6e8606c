"""WARC records, and revisits resolved to the responses that they stand for.

A server that answers 304 Not Modified leaves a `revisit` record with headers and no
content. It is resolved by an as-of join: of the same canonical URL, the latest earlier
full response. The join's result counts if the validators agree: an ETag of the revisit
must weakly equal the response's, else a Last-Modified must be the same, else the
revisit must name the response's payload digest. Then the record gets the response's
content and its headers, updated by those that a 304 may change (`PERMITTED`).

The as-of join is two-level, so a URL with very many captures is never one task's work:
captures are dealt out by ranges of (URL, time) into buckets of about `BUCKET` rows, each
bucket's last response of a URL is carried to later buckets over one row a bucket, and within
a bucket a window finds the latest response. Shuffled are keys and positions; contents are
joined once, by record id, at the end.

write_files() writes WARC files of records compressed one by one, read_files() reads them as
streams, so a worker holds a few records however large a file is. A file has a name of its
own for each attempt and counts once its task has returned that name, so a lost executor
leaves no half file behind that anything reads.

Defined results: revisits without an earlier response are `unresolved`, those whose
validators differ `mismatch`; both keep their own headers and no content. Responses pass
through. At one time a response counts as earlier than a revisit; equal times rank by
record id. Records with a null URL, time or id never resolve. Rows that repeat an id are kept
each and share what it resolves to; of several responses of one id the one whose content has the
smallest hash is used. An empty table gives an empty
result. Records whose length is wrong are kept as `broken` rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.llm.shared import release, remove, scratch, ship, stored

#: Header fields that a 304 response may carry and that replace stored ones (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Query parameters that don't select content.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
#: Rows of a bucket of the as-of join, about; bytes of a file, and of a read; bytes of contents that a worker hands on at a time.
BUCKET, FILE_BYTES, CHUNK, HELD = 1 << 16, 1 << 28, 1 << 16, 1 << 22
RECORD = "record_id long, type string, url string, at long, headers map<string,string>, digest string, content binary"


def canonical_url(url: str | None) -> str | None:
    """Scheme and www. dropped, host in lower case, default port, fragment, tracking parameters and final slash dropped, parameters sorted."""
    if url is None:
        return None
    try:
        u = urlsplit(url.strip())
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return url.strip()
    host = (u.hostname or "").removeprefix("www.")
    query = urlencode(sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING))
    return f"{host}{port}{u.path.rstrip('/') or '/'}" + (f"?{query}" if query else "")


@F.pandas_udf(StringType())
def canonical(urls: pd.Series) -> pd.Series:
    codes, each = pd.factorize(urls)
    found = [*map(canonical_url, each), None]  # code -1: null
    return pd.Series([found[c] for c in codes], dtype=object)


def _validated(r: str = "revisit", f: str = "full") -> Column:
    """Whether the validators of a revisit agree with a response's."""
    weak = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    etag, modified, digest = F.col(f"{r}.etag"), F.col(f"{r}.modified"), F.col(f"{r}.digest")
    agree = F.when(etag.isNotNull(), weak(etag) == weak(F.col(f"{f}.etag"))).when(modified.isNotNull(), modified == F.col(f"{f}.modified")).otherwise(digest == F.col(f"{f}.digest"))
    return F.coalesce(agree, F.lit(False))


def as_of(keyed: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """keyed (record_id, key, at, is_full, etag, modified, digest) -> revisits with `full`, the latest earlier response of the key, or null. bucket: rows of a bucket, about."""
    order = F.struct("at", "is_not_full", "record_id")
    keyed = stored(keyed, "captures")
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // bucket))
    ranged = keyed.withColumn("is_not_full", ~F.col("is_full")).repartitionByRange(parts, "key", "at", "is_not_full", "record_id")
    rows = stored(ranged.withColumn("bucket", F.spark_partition_id()), "buckets")
    release(keyed)
    full = F.when(F.col("is_full"), F.struct("record_id", "at", "etag", "modified", "digest"))
    inside = Window.partitionBy("key", "bucket").orderBy("at", "is_not_full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.filter("is_full").groupBy("key", "bucket").agg(F.max_by(full, order).alias("last_full"))
    asked = rows.filter(~F.col("is_full")).select("key", "bucket").distinct()
    carried = asked.join(carried, ["key", "bucket"], "full").select("key", "bucket", F.last("last_full", ignorenulls=True).over(before).alias("carried"))
    near = rows.withColumn("near", F.last(full, ignorenulls=True).over(inside)).filter(~F.col("is_full"))
    found = near.join(carried.filter(F.col("carried").isNotNull()), ["key", "bucket"], "left")
    return found.select(F.struct("record_id", "etag", "modified", "digest").alias("revisit"), F.coalesce("near", "carried").alias("full"))


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Every record (see RECORD) with `status` (full, resolved, mismatch, unresolved), `source_id` and, if resolved, the response's content and merged headers."""
    ship(records.sparkSession)
    keyed = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", canonical("url").alias("key"), "at", (F.col("type") == "response").alias("is_full"),
        F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), "digest",
    )
    joinable = keyed.filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull())
    found = as_of(joinable, bucket).select(
        F.col("revisit.record_id").alias("_id"),
        F.when(F.col("full").isNull(), "unresolved").when(_validated(), "resolved").otherwise("mismatch").alias("_status"),
        F.when(F.col("full").isNotNull() & _validated(), F.col("full.record_id")).alias("_source"),
        F.hash("revisit.record_id").alias("_spread"),
    ).groupBy("_id").agg(F.min(F.struct("_status", "_source", "_spread")).alias("s")).select("_id", "s.*")
    # Contents of responses are shuffled once, to their revisits; responses themselves pass through.
    donors = records.filter(F.col("type") == "response").select(F.col("record_id").alias("_from"), F.col("headers").alias("_headers"), F.col("content").alias("_content"), F.col("digest").alias("_digest"))
    if not donors.groupBy("_from").agg(F.count("*").alias("n")).filter("n > 1 AND _from IS NOT NULL").isEmpty():
        one = donors.groupBy("_from").agg(F.min(F.struct(F.sha2("_content", 256).alias("h"), "_digest", F.to_json("_headers").alias("j"), F.struct("_content").alias("c"), F.map_entries("_headers").alias("e"))).alias("s"))
        donors = one.select("_from", F.map_from_entries("s.e").alias("_headers"), F.col("s.c._content").alias("_content"), F.col("s._digest").alias("_digest"))
    rows = records.filter(F.coalesce(F.col("type") != "response", F.lit(True)))
    rows = rows.join(found, rows.record_id == found["_id"], "left")
    # Revisits without a source are dealt out by a number of their own, lest they all meet in one task.
    spread = F.when(F.col("_source").isNull(), F.coalesce("_spread", F.hash("record_id"))).otherwise(0)
    rows = rows.withColumn("_spread", spread).join(donors.withColumn("_at", F.lit(0)), (F.col("_source") == F.col("_from")) & (F.col("_spread") == F.col("_at")), "left")
    news = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("_headers", lambda k, v: ~F.array_contains(F.map_keys(news), k)), news)
    done = F.col("_source").isNotNull()
    rows = rows.select(
        "record_id", "type", "url", "at",
        F.when(F.col("type") == "revisit", F.coalesce("_status", F.lit("unresolved"))).otherwise(F.coalesce("type", F.lit("unknown"))).alias("status"),
        F.col("_source").alias("source_id"),
        F.when(done, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("_digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, F.col("_content")).otherwise(F.col("content")).alias("content"),
    )
    passed = records.filter(F.col("type") == "response").select("record_id", "type", "url", "at", F.lit("full").alias("status"), F.lit(None).cast("bigint").alias("source_id"), "headers", "digest", "content")
    return passed.union(rows)


def warc_bytes(record_id: int, kind: str, url: str | None, at: int | None, headers: dict[str, str], content: bytes | None, digest: str | None = None) -> bytes:
    """One WARC/1.1 record, compressed on its own."""
    status = "HTTP/1.1 304 Not Modified" if kind == "revisit" else "HTTP/1.1 200 OK"
    block = "\r\n".join([status, *(f"{k}: {v}" for k, v in headers.items()), "", ""]).encode() + (content or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record_id}>"]
    if at is not None:
        head.append(f"WARC-Date: {datetime.fromtimestamp(at, UTC):%Y-%m-%dT%H:%M:%SZ}")
    head += [f"WARC-Target-URI: {url}"] * (url is not None) + [f"WARC-Payload-Digest: sha1:{digest}"] * (digest is not None)
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified"] * (kind == "revisit")
    return gzip.compress("\r\n".join([*head, "Content-Type: application/http", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n", 1, mtime=0)


def _members(file: BinaryIO) -> Iterator[bytes]:
    """What the compressed members of a file hold, one by one. The last may be cut short."""
    data = file.read(CHUNK)
    while data:
        unzip, parts = zlib.decompressobj(31), []
        while data:
            parts.append(unzip.decompress(data))
            data = unzip.unused_data if unzip.eof else file.read(CHUNK)
            if unzip.eof:
                break
        yield parts[0] if len(parts) == 1 else b"".join(parts)
        data = data or file.read(CHUNK)


def parse_warc(file: bytes | BinaryIO) -> Iterator[dict]:
    """The records of a file of compressed records."""
    for raw in _members(io.BytesIO(file) if isinstance(file, bytes) else file):
        at = 0
        while (at := _past_line_ends(raw, at)) < len(raw):
            end = raw.find(b"\r\n\r\n", at)
            end = len(raw) if end < 0 else end
            fields = _fields(raw[at:end])
            size = int(fields.get("content-length", "0"))
            block, at = raw[end + 4 : end + 4 + size], end + 4 + size
            http, _, content = block.partition(b"\r\n\r\n")
            kind = fields.get("warc-type", "unknown") if len(block) == size else "broken"
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or (hashlib.sha1(content).hexdigest() if kind == "response" else None)
            number = "".join(filter(str.isdigit, fields.get("warc-record-id", "")))
            yield {"record_id": int(number) if number else None, "type": kind, "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "headers": _fields(http), "digest": digest, "content": None if kind == "revisit" else content}


def _past_line_ends(raw: bytes, at: int) -> int:
    while raw[at : at + 1] in (b"\r", b"\n"):
        at += 1
    return at


def _fields(head: bytes) -> dict[str, str]:
    if b"\r\n " in head or b"\r\n\t" in head:
        head = re.sub(rb"\r\n[ \t]+", b" ", head)
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


def _row_bytes(b: pa.RecordBatch) -> Iterator[bytes]:
    columns = [c.to_pylist() for c in b.columns]
    for record_id, kind, url, at, headers, digest, content in zip(*columns, strict=True):
        yield warc_bytes(record_id, kind, url, at, dict(headers or []), content, digest)


_WRITTEN = ["record_id", "type", "url", "at", "headers", "digest", "content"]


def write_warc(records: DataFrame) -> DataFrame:
    """records -> (content binary): one compressed record each; laid end to end they are a file."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_row_bytes(b), pa.binary())], ["content"])

    return records.select(*_WRITTEN).mapInArrow(run, "content binary")


def write_files(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes WARC files into path, a folder that all executors share (any that pyarrow.fs opens). (file, records, bytes) of each."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(path)
        store.create_dir(top, recursive=True)
        name, out, n, size = "", None, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

        for b in batches:
            for data in _row_bytes(b):
                if out is None:
                    name, n, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(name, compression=None)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(records.select(*_WRITTEN).mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def _store(path: str) -> tuple[FileSystem, str]:
    if "://" not in path:
        path = f"file://{os.path.abspath(path.removeprefix('file:'))}"
    return FileSystem.from_uri(path)


_NAMES = ["record_id", "type", "url", "date", "headers", "digest", "content"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
_READ = "record_id long, type string, url string, date string, headers map<string,string>, digest string, content binary"


def _batches(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)

    for r in records:
        rows.append(r)
        held += len(r["content"] or b"") + 500
        if held > HELD:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _timed(read: DataFrame) -> DataFrame:
    return read.select("record_id", "type", "url", F.try_to_timestamp("date").cast("long").alias("at"), "headers", "digest", "content")


def read_warc(files: DataFrame) -> DataFrame:
    """files (content binary, as spark.read.format('binaryFile') gives) -> records. For files that fit in memory; read_files() reads any."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                yield from _batches(parse_warc(b.column(0)[k].as_py() or b""))

    return _timed(files.select("content").mapInArrow(run, _READ))


def read_files(files: DataFrame, path: str) -> DataFrame:
    """files (file), as write_files() gives for this path -> records. A task has some files, and reads each as a stream."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(name, compression=None) as f:
                    yield from _batches(parse_warc(f))

    spread = files.select("file").repartition(max(1, min(files.count(), 1 << 16)))
    return _timed(spread.mapInArrow(run, _READ))


def written_and_read(records: DataFrame) -> DataFrame:
    """The records as read_files() gives them from the files that write_files() makes in the shared folder; these are deleted then."""
    spark = records.sparkSession
    path = scratch(spark, "warc")
    files = write_files(records, path)
    read = stored(read_files(files, path), "records", "zstd")
    remove(spark, path)
    release(files)
    return read


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of pages crawled three times: page_id is the hour of the first capture. The server answers the second with 304 if page_id is even, and else with the page; the third with 304 always.

    An ETag is the content's digest, but for every seventh page, whose ETag has changed by the third capture, and every fifth, which sends Last-Modified alone.
    Every eleventh page's first capture is missing, so a revisit may have no earlier response.
    """
    page = pages.select(pages["page_id"].cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = page.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")).filter((F.col("n") > 0) | (F.col("page_id") % 11 != 0))
    full = (F.col("n") == 0) | ((F.col("n") == 1) & (F.col("page_id") % 2 != 0))
    digest = F.sha1(F.col("html").cast("binary"))
    at = (F.col("page_id") * 3600 + F.col("n") * 86400).cast("bigint")
    etag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.when((F.col("page_id") % 7 == 0) & (F.col("n") == 2), "-new").otherwise(""), F.lit('"'))
    only_date = F.col("page_id") % 5 == 0
    headers = F.map_filter(
        F.create_map(
            F.lit("etag"), F.when(~only_date, etag),
            F.lit("last-modified"), F.when(only_date, F.concat(F.lit("day "), F.col("page_id").cast("string"))),
            F.lit("date"), at.cast("string"),
            F.lit("content-type"), F.when(full, "text/html; charset=utf-8").otherwise("text/plain"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return rows.select(
        (F.col("page_id") * 3 + F.col("n")).alias("record_id"), F.when(full, "response").otherwise("revisit").alias("type"), "url", at.alias("at"), headers.alias("headers"),
        F.when(full, digest).alias("digest"), F.when(full, F.col("html").cast("binary")).alias("content"),
    )
