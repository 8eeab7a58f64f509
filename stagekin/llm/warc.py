"""WARC archives: written in parallel, read in parallel, records assembled to captures.

``write`` stores each page as a request, a response or revisit, and a metadata record, every record
a gzip member of its own. ``read`` streams the archives and gives one row per record. ``captures``
joins the records that name each other in WARC-Concurrent-To and emits one nested row per capture.

Of pages with equal payloads of at least ``least`` bytes the one with the largest id is stored as
response (repeated rows of that id too); the others are revisits without payload that refer to it.
Smaller payloads are always stored. A null html is an empty payload; a page with a null id never is
the one referred to while its group has another.

A task that is run again writes files of other names; only files in the manifest, which holds the
tasks that ended well, are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import batch, new_folder, written

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64_000_000
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()),
    ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])
RECORD_DDL = ("record_id string, record_type string, concurrent_to string, target_uri string, payload_digest string, "
              "payload_bytes long, fields map<string,string>, payload binary")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers,
             ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def _field(text: str | None) -> str:
    """A header value: line ends would end the header."""
    return "".join(" " if c in "\r\n" else c for c in text or "")


def capture_records(page_id: int | None, url: str | None, payload: bytes, original: dict | None) -> list[bytes]:
    """The packed records of one page; ``original``: id and url of the page that has the payload, if another."""
    key, digest, url = uuid.uuid4(), sha1_base32(payload), _field(url)
    main, kind = f"urn:uuid:{key}", "revisit" if original else "response"
    common = [("WARC-Target-URI", url)]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", _field(original["url"]))] if original else []
    fields = {"pageId": "" if page_id is None else page_id, "payloadLength": len(payload)}
    if original:
        fields["refersToPageId"] = original["page_id"]
    near = [("WARC-Concurrent-To", f"<{main}>")]
    return [
        _record(kind, main, [*common, ("WARC-Payload-Digest", f"sha1:{digest}"), *more,
                             ("Content-Type", "application/http; msgtype=response")],
                status + (b"" if original else payload)),
        _record("request", f"{main}-request", [*common, *near, ("Content-Type", "application/http; msgtype=request")],
                f"GET {url} HTTP/1.1\r\n\r\n".encode()),
        _record("metadata", f"{main}-metadata", [*common, *near, ("Content-Type", "application/warc-fields")],
                "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()),
    ]


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and ``original`` (page_id, url): null for the pages that are stored whole."""
    html = F.coalesce("html", F.lit(""))
    digest = F.sha2(html, 256)
    keyed = pages.select("page_id", "url", html.alias("html"), digest.alias("_digest"),
                         (F.octet_length(html) >= least).alias("_counts"))
    # one narrow row per payload that is there more than once: copies are counted before the shuffle
    groups = keyed.filter("_counts").groupBy("_digest").agg(
        F.max("page_id").alias("_id"), F.max_by(F.coalesce("url", F.lit("")), "page_id").alias("_url"),
        F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _id is not null").drop("_n")
    found = keyed.join(groups, "_digest", "left")
    other = F.col("_counts") & F.col("_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_id"))
    return found.select("page_id", "url", "html", F.when(
        other, F.struct(F.col("_id").alias("page_id"), F.col("_url").alias("url"))).alias("original"))


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below ``folder``; returns the manifest (path, n_records, n_bytes)."""
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, done, n, size = None, [], 0, 0
        for rows in batches:
            for row in rows.to_pylist():
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                for packed in capture_records(row["page_id"], row["url"], row["html"].encode("utf-8"), row["original"]):
                    out.write(packed)
                    n, size = n + 1, size + len(packed)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield batch(schema, *(zip(*done) if done else ([], [], [])))

    return written(with_originals(pages, least).mapInArrow(store, MANIFEST), "warc-manifest")


def _parse(packed: bytes, with_payload: bool) -> tuple:
    head, _, block = packed.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = block[: int(headers["content-length"])]
    kind, payload, fields, size = headers["warc-type"], None, None, None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if sha1_base32(payload) != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    elif kind == "metadata":
        parts = (line.partition(":") for line in block.decode("utf-8").split("\r\n") if line)
        fields = [(k, v.strip()) for k, _, v in parts]
    ids = [headers[k].strip("<>") if k in headers else None for k in ("warc-record-id", "warc-concurrent-to")]
    return (ids[0], kind, ids[1], headers.get("warc-target-uri"), digest, size, fields,
            payload if with_payload else None)


def members(stream, step: int = 1 << 14) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one in memory at a time.

    What follows a member in a read is copied once for it, so reads are short.
    """
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(step):
        while data:
            parts.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                yield b"".join(parts)
                data, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
    if b"".join(parts):
        raise ValueError("the last record is cut off")


def read(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest``; archives are streamed, whichever their size."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for rows in batches:
            for path in rows.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    group, size = [], 0
                    for record in members(stream):
                        group.append(_parse(record, with_payload))
                        size += len(record)
                        if size >= 8_000_000:
                            yield batch(RECORD, *zip(*group))
                            group, size = [], 0
                    if group:
                        yield batch(RECORD, *zip(*group))

    parts = max(1, manifest.count())
    return manifest.select("path").repartition(parts, "path").mapInArrow(load, RECORD_DDL)


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit: capture, request and metadata as structs.

    Request and metadata are those that name the capture in WARC-Concurrent-To, or null; of several
    the one with the smallest record id.
    """
    def near(kind: str) -> DataFrame:
        row = F.struct("record_id", "target_uri", "fields")
        return (records.filter(F.col("record_type") == kind).filter("concurrent_to is not null")
                .groupBy(F.col("concurrent_to").alias("_of")).agg(F.min_by(row, "record_id").alias(kind)))

    main = records.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("_of"),
        F.struct(*[c for c in records.columns if c not in ("concurrent_to", "fields")]).alias("capture"))
    return main.join(near("request"), "_of", "left").join(near("metadata"), "_of", "left").drop("_of")


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Writes the pages and reads the captures back from the archives."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    records = written(read(write(pages, folder, least), folder, with_payload), "warc-records")
    return captures(records)
