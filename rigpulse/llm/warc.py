"""WARC archives: write pages as records, read them back sequentially.

Every record is a gzip member of its own. The reader inflates members incrementally, frames header and block by
Content-Length, recomputes block and payload digests while it passes over the bytes and never holds more than a chunk
of a payload that is not asked for. Archives are named by the attempt that wrote them and only those in the returned
manifest count, so lost and repeated tasks leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigpulse.llm.common import Workspace, slices

#: An archive is closed once it has grown to this.
ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 1000
_CHUNK = 1 << 18
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _digest(hasher) -> str:
    return "sha1:" + base64.b32encode(hasher.digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()),
            f"WARC-Block-Digest: {_digest(hashlib.sha1(block))}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, wbits=31)
    raw = "WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n"
    return packer.compress(raw.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the page as its payload, or a revisit of the page ``refers_to`` without it."""
    own = f"{_ID}{page_id}" if page_id is not None else f"{_ID}none:{uuid.uuid4()}"
    target = "".join(c for c in url or "" if c.isprintable() and c != " ") or own
    headers = {"WARC-Record-ID": f"<{own}>", "WARC-Date": _DATE, "WARC-Target-URI": target,
               "WARC-Payload-Digest": _digest(hashlib.sha1(payload)), "Content-Type": "application/http; msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Refers-To": f"<{_ID}{refers_to}>", "WARC-Profile": _PROFILE}, http)


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int = 0
    payload_sha1: str = ""
    payload: bytes | None = None
    http: dict[str, str] = field(default_factory=dict)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _parsed(parts: Iterator[bytes], with_payload: bool) -> Record:
    """The record whose inflated bytes ``parts`` yields, with framing and digests verified."""
    held = b""

    def until(mark: bytes) -> bytes:
        nonlocal held
        while (at := held.find(mark)) < 0:
            more = next(parts, None)
            if more is None:
                raise ValueError("record ends in its header")
            held += more
        raw, held = held[:at], held[at + len(mark):]
        return raw

    head = until(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    found = Record(_headers(head))
    left = int(found.headers["content-length"])
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
    if found.headers.get("content-type", "").startswith("application/http"):
        http = until(b"\r\n\r\n")
        found.http = _headers(http)
        block.update(http + b"\r\n\r\n")
        left -= len(http) + 4
    body = left
    while left > 0:
        if not held:
            held = next(parts, b"")
            if not held:
                raise ValueError("block is shorter than its Content-Length")
        piece, held = held[:left], held[left:]
        left -= len(piece)
        block.update(piece)
        payload.update(piece)
        if with_payload:
            kept.append(piece)
    if left < 0 or held + b"".join(parts) != b"\r\n\r\n":
        raise ValueError("record does not end after its Content-Length")
    named = found.headers.get("warc-payload-digest")
    if found.headers.get("warc-block-digest", _digest(block)) != _digest(block):
        raise ValueError("block digest differs")
    if found.headers["warc-type"] == "revisit":
        found.payload_bytes = int(found.http.get("content-length", 0))
        found.payload_sha1 = base64.b32decode(named.partition(":")[2]).hex()
        return found
    if named and named != _digest(payload):
        raise ValueError("payload digest differs")
    found.payload_bytes, found.payload_sha1 = body, payload.hexdigest()
    found.payload = b"".join(kept) if with_payload else None
    return found


def records(stream, with_payload: bool = False) -> Iterator[Record]:
    """All records of an open archive, in order."""
    rest = stream.read(_CHUNK)

    def member() -> Iterator[bytes]:
        nonlocal rest
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not rest:
                rest = stream.read(_CHUNK)
                if not rest:
                    raise ValueError("archive ends inside a record")
            out = inflate.decompress(rest, _CHUNK)
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if out:
                yield out

    while rest or (rest := stream.read(_CHUNK)):
        yield _parsed(member(), with_payload)


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to): null html is empty; refers_to is null for responses.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response. Repeated rows of that id are all
    responses; rows without an id refer to it, or are responses if no row of the group has one. Shorter payloads have no
    group and stay out of the join.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    long = rows.where(F.length("payload") >= least).withColumn("digest", F.sha1("payload"))
    groups = (long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "last"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    named = long.join(groups, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    short = rows.where(F.length("payload") < least)
    return named.union(short.select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))


def write_archives(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Manifest (path, n_records, n_bytes) of the archives that hold ``rows`` of ``with_revisits``."""
    folder = ws.folder("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(folder)
        system.create_dir(base, recursive=True)
        out, made = None, []

        def closed():
            out.close()
            made.append((f"{folder}/{name}", count, size))

        for batch in slices(batches, "payload", 8 << 20):
            for row in batch.to_pylist():
                if out is None:
                    name, count = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    info = record("warcinfo", {"WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": _DATE,
                                               "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    size = out.write(info)
                size += out.write(page_record(row["page_id"], row["url"], row["payload"], row["refers_to"]))
                count += 1
                if size >= ARCHIVE_BYTES:
                    closed()
                    out = None
        if out is not None:
            closed()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["path", "n_records", "n_bytes"])

    return ws.table(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every response and revisit of the archives: record_type, page_id, refers_to, target_uri, payload_bytes,
    payload_digest (hex SHA-1, verified) and payload. A damaged archive fails the job."""
    schema = ("record_type string, page_id long, refers_to long, target_uri string, payload_bytes long, "
              "payload_digest string, payload binary")
    target = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
                        ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.binary())])

    def number(urn: str | None) -> int | None:
        digits = (urn or "").strip("<>").removeprefix(_ID)
        return int(digits) if digits.lstrip("-").isdigit() else None

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in (p.as_py() for b in batches for p in b.column(0)):
            system, inner = place(path)
            with system.open_input_stream(inner, compression=None) as stream:
                for r in records(stream, with_payload):
                    if r.headers["warc-type"] in ("response", "revisit"):
                        rows.append((r.headers["warc-type"], number(r.headers["warc-record-id"]),
                                     number(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri"),
                                     r.payload_bytes, r.payload_sha1, r.payload))
                        held += len(r.payload or b"") + 200
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, schema)
