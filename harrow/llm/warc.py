"""WARC archives, index first.

Pages become WARC records, each a gzip member of its own. Of pages with equal payloads the one with
the largest id is the response and the others are revisits that name it. The writer returns an
index, a row per record with file, offset, length, URL and digest, that is written as a table beside
the archives; selections and joins run on it alone. A reader takes the selected records in order of
file and offset and fetches neighbours with one read.

Files go to a folder that all machines share, by pyarrow's file systems. A task attempt writes files
of its own name and only the attempt that counts is in the index, so lost executors leave unlisted
files at most, never a wrong record.

Defined results: a null payload is empty; a null id ranks below all others and of rows with one
payload and the same largest id each is a response; payloads under ``least`` bytes are all
responses; a null URL has no target line; an empty table gives an empty index. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A new archive begins after this many compressed bytes; reads this close are one read of at most this size.
FILE_BYTES, GAP_BYTES, READ_BYTES = 64 << 20, 64 << 10, 8 << 20
#: A task reads about as many compressed bytes.
TASK_BYTES = 32 << 20
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, payload_bytes long"
_DATE = "2024-01-01T00:00:00Z"


def open_store(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^file:/*", "file:///", uri))


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, original: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the payload's HTTP head, without the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(original)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields of a record, its HTTP head's payload length and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": payload}


def _page(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "none" else int(found)


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``folder``; the index, read back from its own table there."""
    own = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.encode(html, "UTF-8"), F.lit(b"")).alias("payload"))
    own = own.withColumn("key", F.unhex(F.sha1("payload")))
    same = own.groupBy("key").agg(F.max("page_id").alias("largest"), F.max(F.octet_length("payload")).alias("n"), F.count("*").alias("c")).where(F.col("c") > 1).where(F.col("n") >= least)
    same, most = common.cut(same.select("key", "largest", "c")), pages.count()
    # a payload that very many pages share stays where it is, so that no task gets all of its copies
    dealt = common.hot_join(own, same, "key", "c", most, "left").select("page_id", "url", "payload", "largest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        out, name, at, rows = None, "", 0, []

        def listed() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
            rows.clear()
            return batch

        for batch in batches:
            for page, link, payload, largest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/archives/{name}", compression=None)
                revisit = largest is not None and page != largest
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(record(page, link, payload, digest, largest, revisit)) + packer.flush()
                out.write(member)
                rows.append((name, at, len(member), page, link, digest, "revisit" if revisit else "response", len(payload)))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield listed()
        if out is not None:
            out.close()

    store, path = open_store(folder)
    store.create_dir(f"{path}/archives", recursive=True)
    common.bound_batches(pages.sparkSession)
    dealt.mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """One row per row of ``index``, from the archives alone: page_id, url, record_type, refers_to,
    payload_digest, payload_bytes and payload (null for a revisit). A record whose payload doesn't have its digest is an error."""

    def fetch(file, spans: list[tuple[int, int]]) -> Iterator[bytes]:
        """The records at sorted (offset, length), neighbours by one read."""
        i = 0
        while i < len(spans):
            j, start, end = i + 1, spans[i][0], sum(spans[i])
            while j < len(spans) and spans[j][0] <= end + GAP_BYTES and sum(spans[j]) - start <= READ_BYTES:
                end = max(end, sum(spans[j]))
                j += 1
            data = file.read_at(end - start, start)
            yield from (data[a - start : a - start + n] for a, n in spans[i:j])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            a = 0
            while a < len(files):
                b = a
                while b < len(files) and files[b] == files[a]:
                    b += 1
                with store.open_input_file(f"{path}/archives/{files[a]}") as file:
                    for raw in fetch(file, list(zip(offsets[a:b], lengths[a:b], strict=True))):
                        r = parse(zlib.decompress(raw, 31))
                        digest, revisit = r["WARC-Payload-Digest"].removeprefix("sha1:"), r["WARC-Type"] == "revisit"
                        if not revisit and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                            raise ValueError(f"a record of {files[a]} doesn't have its digest {digest}")
                        out.append((_page(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), r["WARC-Type"], _page(r["WARC-Refers-To"]) if revisit else None, digest, r["payload_bytes"], None if revisit else r["payload"]))
                a = b
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    parts = max(1, (index.agg(F.sum("length").alias("n")).first()["n"] or 0) // TASK_BYTES, common.partitions(index.sparkSession))
    spans = index.select("file", "offset", "length").repartitionByRange(parts, F.col("file"), F.col("offset")).sortWithinPartitions("file", "offset")
    common.bound_batches(index.sparkSession)
    return spans.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def new_folder(spark: SparkSession) -> str:
    """A folder for archives under the shared one."""
    return f"{common.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
