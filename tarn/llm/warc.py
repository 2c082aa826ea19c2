"""WARC archives with revisit resolution.

Headers (id, URL, size, payload digest) are shuffled by digest; of records with equal payloads one stays a response
and the others become revisits that refer to it.  Revisits are made of headers alone: their bodies are never shuffled,
since tasks keep one body a digest before they send any, and payloads too small to be shared stay where they were read.
Archives are written by the tasks into a folder that all executors share, one gzip member a record, under names that no
other attempt uses; the manifest of finished files is what counts, so files of lost or repeated attempts are never
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed, shared_base

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "file string, records long, bytes long"
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
RECORDS_DDL = "page_id long, url string, record_type string, record_id string, refers_to_id string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name under the cluster's checkpoint folder."""
    return f"{shared_base(spark)}/warc-{uuid.uuid4().hex}"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri)


RESOLVED = ("page_id", "url", "html", "digest", "n", "record_type", "refers_to", "refers_to_url")


def resolve(pages: DataFrame, *, min_bytes: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, html) with payload digest and size, record type, and the response that a revisit refers to.

    A revisit has no html.  Payloads are equal when SHA-1, a second hash and size are.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    none = F.lit(None)
    small = rows.where(F.col("n") < min_bytes).select("page_id", "url", "html", "digest", "n", F.lit("response").alias("record_type"), none.cast("long").alias("refers_to"), none.cast("string").alias("refers_to_url"))
    large = rows.where(F.col("n") >= min_bytes).withColumn("x", F.xxhash64("html"))
    key = ("digest", "x", "n")
    # One body a digest leaves each task, however many pages have it.
    kept = large.groupBy(*key).agg(F.max(F.struct("page_id", "url", "html")).alias("r"))
    kept = kept.select("r.page_id", "r.url", "r.html", "digest", "n", F.lit("response").alias("record_type"), none.cast("long").alias("refers_to"), none.cast("string").alias("refers_to_url"))
    # All other pages of the digest, from headers alone; rows that repeat a page are counted, not compared.
    heads = large.groupBy(*key, "page_id", "url").agg(F.count(F.lit(1)).alias("times"))
    first = heads.groupBy(*key).agg(F.max(F.struct("page_id", "url")).alias("r"), F.sum("times").alias("size")).where("size > 1")
    again = heads.join(first, list(key))
    is_first = F.col("page_id").eqNullSafe(F.col("r.page_id")) & F.col("url").eqNullSafe(F.col("r.url"))
    again = again.withColumn("times", F.col("times") - F.when(is_first, 1).otherwise(0)).where("times > 0")
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    again = again.select("page_id", "url", none.cast("string").alias("html"), "digest", "n", F.lit("revisit").alias("record_type"), F.col("r.page_id").alias("refers_to"), F.col("r.url").alias("refers_to_url"))
    return small.unionByName(kept).unionByName(again)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}/{digest}')}>"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, html: str | None, digest: str, size: int, kind: str, refers_to: int | None, refers_to_url: str | None, date: str) -> bytes:
    """One WARC record with fresh headers; a revisit has the response's HTTP headers and no payload."""
    body = HTTP + b"Content-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
        if refers_to_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_to_url)}")
    else:
        body += (html or "").encode("utf-8", "surrogatepass")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str, date: str):
    def run(batches):
        from pyspark import TaskContext

        out, name, records, size = None, None, 0, 0
        try:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                    if out is None:
                        store, path = _store(folder)
                        store.create_dir(path, recursive=True)
                        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 22\r\n\r\nformat: WARC File 1.1\n\r\n\r\n".encode()
                        size += out.write(_member(info)) or 0
                    raw = _member(record(*row, date))
                    out.write(raw)
                    records, size = records + 1, size + len(raw)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])], names=["file", "records", "bytes"])

    return run


def write_archives(resolved: DataFrame, folder: str, *, date: str | None = None) -> DataFrame:
    """Writes what ``resolve`` gave into ``folder``; the manifest (file, records, bytes) names the files that count."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return checkpointed(resolved.select(*RESOLVED).mapInArrow(_writer(folder, date), MANIFEST))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a gzipped archive, one record in memory at a time."""
    held, left = zlib.decompressobj(31), b""
    buf = bytearray()
    while True:
        raw = left or stream.read(1 << 20)
        left = b""
        if not raw:
            break
        buf += held.decompress(raw)
        if held.eof:
            left, held = held.unused_data, zlib.decompressobj(31)
            cut = buf.index(b"\r\n\r\n")
            lines = bytes(buf[:cut]).decode("utf-8", "surrogatepass").split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            yield head, bytes(buf[cut + 4 : cut + 4 + int(head["Content-Length"])])
            buf.clear()


def _read(batches):
    def made(rows):
        cols = list(zip(*rows, strict=True)) or [[] for _ in RECORDS]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, RECORDS, strict=True)], schema=RECORDS)

    for batch in batches:
        for file in batch.column(0).to_pylist():
            store, path = _store(file)
            out, size = [], 0
            with store.open_input_stream(path, compression=None) as stream:
                for head, block in parse(stream):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                    cut = block.index(b"\r\n\r\n")
                    length = int(_LENGTH.search(block, 0, cut + 2)[1])
                    payload = block[cut + 4 :] if head["WARC-Type"] == "response" else None
                    digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                    if payload is not None and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{file}: a payload does not match its digest")
                    out.append((page and int(page), head.get("WARC-Target-URI"), head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), refers and int(refers), digest, length, payload))
                    size += len(block)
                    if size > 8 << 20:
                        yield made(out)
                        out, size = [], 0
            if out:
                yield made(out)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files, each file read once.

    A revisit has no payload; its payload_bytes are what the HTTP headers in its own block say.
    """
    # A given number of parts, which Spark does not merge however short the list of files is.
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(_read, RECORDS_DDL)


def archive(pages: DataFrame, *, folder: str | None = None, min_bytes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(manifest, records read back) of ``pages`` written as deduplicated WARC archives.

    Of records with equal payloads (UTF-8 of html) of ``min_bytes`` or more, that with the largest page_id (of equal
    ones the largest url) is the response and the others revisit it; smaller ones are all responses.  Null html is an
    empty payload, null url no header.  Rows that repeat the response's page and url revisit it like any other; a null
    page_id is smaller than any.  A payload of any length is one record, held whole by the task that writes or reads
    it.  Other columns are ignored, whatever their names.  An empty table writes no file.
    """
    folder = folder or shared_folder(pages.sparkSession)
    manifest = write_archives(resolve(pages, min_bytes=min_bytes), folder)
    return manifest, read_archives(manifest)
