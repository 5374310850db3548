"""WARC archives: writing captures, reading them back, and assembling each capture's records.

A capture is three records: a request, a response (or, for a payload that another capture has stored, a
revisit) and a metadata record. Request and metadata name the response's record id in WARC-Concurrent-To; the
reader yields single records and assemble() joins them by that id into one nested row for each capture.
Each record is a gzip member of its own; executors write archives under a temporary name in the shared folder and
rename them when complete. Names hold the attempt that wrote them, and only those that a task has committed are read, so
that a task that is run twice leaves files behind but no record twice.

Of pages with equal payloads of LEAST bytes or more, that with the largest page_id is the response and the others
revisit it.

Defined results: null html is an empty payload and a null url an empty one; rows that are equal in page_id, url and html
stay as many rows; a null page_id is never revisited, unless every equal payload has one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import scratch_path, shuffle_width, written

LEAST = 1000
#: An archive is closed when its records reach so many bytes.
ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def deduplicated(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, row (a number of its own) and, for revisits, head: struct(page_id, url, row) of the response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.monotonically_increasing_id().alias("row"))
    large = rows.where(F.octet_length("html") >= LEAST)
    heads = large.groupBy("digest").agg(F.max(F.struct("page_id", "url", "row")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(heads, "digest", "left")
    revisits = F.col("head.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head.page_id"))
    return joined.select("page_id", "url", "html", "digest", "row", F.when(revisits, F.col("head")).alias("head"))


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def capture(page_id: int | None, url: str, payload: bytes, digest: str, row: int, head: dict | None) -> bytes:
    """The three records of one page; row tells pages that are equal in all else apart."""
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    own = _urn(page_id, url, digest, row)
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    about = {"page-id": "" if page_id is None else str(page_id), "payload-length": str(len(payload))}
    if head:
        refers = [("WARC-Refers-To", _urn(head["page_id"], head["url"], digest, head["row"])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        main = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *refers, ("WARC-Payload-Digest", sha1), ("Content-Type", "application/http;msgtype=response")], http)
    else:
        main = _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", sha1), ("Content-Type", "application/http;msgtype=response")], http + payload)
    path = re.sub(r"^[a-z+.-]+://[^/]*", "", uri) or "/"
    ask = f"GET {path} HTTP/1.1\r\n\r\n".encode()
    fields = "".join(f"{k}: {v}\r\n" for k, v in about.items()).encode()
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], ask)
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], fields)
    return request + main + metadata


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes archives under path, a folder that all executors reach; returns their names, captures and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out, name, held, size = None, "", 0, 0

        def close() -> None:
            out.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")
            done.append((name, held, size))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, held, size = f"part-{context.partitionId():06d}-{len(done):04d}-{context.taskAttemptId()}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/.{name}", compression=None)
                data = capture(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["row"], row["head"])
                out.write(data)
                held, size = held + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["name", "captures", "bytes"])

    return written(pages.mapInArrow(run, "name string, captures long, bytes long"), "warc-names")


def parse_record(stream) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of the next record of a binary stream; None at its end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    headers: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        k, _, v = line.decode().partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, stream.read(int(headers["content-length"]))


def described(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """A row of RECORD. The payload of a response is what follows its HTTP headers, and is checked against its digest."""
    kind = headers["warc-type"]
    digest, size, payload, fields = None, None, None, None
    if kind in ("response", "revisit"):
        _, _, body = block.partition(b"\r\n\r\n")
        told = headers.get("warc-payload-digest", "")
        digest = base64.b32decode(told.removeprefix("sha1:")).hex() if told.startswith("sha1:") else None
        if kind == "response":
            found = hashlib.sha1(body).hexdigest()
            if digest not in (None, found):
                raise ValueError(f"payload of {headers['warc-record-id']} doesn't have its digest")
            digest, size, payload = found, len(body), body if with_payload else None
    elif kind == "metadata":
        fields = [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in block.decode().split("\r\n") if x]
    return {"record_id": headers["warc-record-id"], "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "target_uri": headers.get("warc-target-uri"), "refers_to_id": headers.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "fields": fields, "payload": payload}


_ARROW = pa.schema([(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "target_uri", "refers_to_id", "payload_digest")] + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def read_archives(names: DataFrame, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the named archives under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    rows, size = [], 0
                    while (got := parse_record(stream)) is not None:
                        rows.append(described(*got, with_payload))
                        size += 500 + len(rows[-1]["payload"] or b"")
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    width = shuffle_width(names.sparkSession)
    return names.select("name").repartition(width, "name").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: capture_id and its request, response and metadata as nested columns.

    Captures of other archives that share an id come out as often as their response was read."""
    main = F.col("type").isin("response", "revisit")
    kept = [c for c in records.columns if c != "concurrent_to"]
    pick = lambda when: F.max_by(F.struct(*kept), F.when(when, F.col("record_id")))
    grouped = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        pick(F.col("type") == "request").alias("request"), pick(main).alias("response"), pick(F.col("type") == "metadata").alias("metadata"), F.count(F.when(main, 1)).alias("n")
    )
    return grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n"))))).drop("n", "copy")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages in a new folder of the shared one, reads it back and assembles captures."""
    spark: SparkSession = pages.sparkSession
    path = scratch_path(spark, "warc")
    names = write_archives(deduplicated(pages), path)
    return assemble(read_archives(names, path).drop("payload"))


def digest(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to: the page of the capture that WARC-Refers-To names."""
    number = lambda key: F.col("metadata.fields")[key].try_cast("long")
    size = F.coalesce("response.payload_bytes", number("payload-length")).alias("payload_bytes")
    told = captures.select("capture_id", number("page-id").alias("page_id"), size, F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to_id").alias("to"))
    told = written(told, "warc-told")
    revisited = told.where("to IS NOT NULL").select(F.col("to").alias("capture_id")).distinct()
    heads = told.join(revisited, "capture_id", "left_semi").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to")).distinct()
    return told.join(heads, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
