"""WARC archives: written by executors with one gzip member a record, read back as a stream.

Each task writes whole archives of its own under fresh names, and only those of the attempt that succeeded enter the
manifest, so a lost executor leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import scratch, stored, table, with_top
from .files import make_folder, opened

#: Payloads from this size on are stored once.
SHARED_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
BROADCAST_ROWS = 1_000_000
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"


def revisits(pages: DataFrame) -> DataFrame:
    """again_id, again_digest and best of the rows whose payload a row with a larger page_id has too; no html moves."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.where(F.octet_length(payload) >= SHARED_BYTES).select("page_id", F.sha1(payload.cast("binary")).alias("digest"))
    found = with_top(rows, ["digest"], "page_id", "best", F.max).where("best is not null and not page_id <=> best")
    return found.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "best").distinct()


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size, record_type, refers_to: of equal payloads the largest page_id is the response.

    Null html is an empty payload. Rows that repeat the largest page_id are all responses; a null page_id counts as
    smaller than any other. Revisits are broadcast up to BROADCAST_ROWS of them (about 100 bytes each); beyond that
    pages are joined by id and digest.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    again = stored(revisits(pages))
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(again) if few else again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    again = F.col("best").isNotNull()
    return rows.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "digest", "size", F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("best").alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, html, digest, size, kind, refers_to) -> bytes:
    """One WARC/1.1 record: HTTP headers, and the payload unless it is a revisit."""
    body = b"" if html is None else html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    mark = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{mark}",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(http + body).digest()).decode()}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Archives in folder of all rows; returns their manifest (path, records, bytes), itself stored."""
    make_folder(folder)

    def run(batches):
        out = path = None
        done, records, size = [], 0, 0

        def close():
            out.close()
            done.append((path, records, size))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, local = opened(path)
                    out = system.open_output_stream(local, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(*row)) + packer.flush()
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return stored(with_types(pages).mapInArrow(run, "path string, records long, bytes long"))


def members(stream):
    """Each gzip member of a stream, decompressed bit by bit as the stream is read."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(CHUNK)
            if not rest:
                if parts:
                    raise EOFError("the archive ends within a record")
                return
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """A record's fields; framed by Content-Length, checked against its digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) < size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    intact = base64.b32encode(hashlib.sha1(block).digest()).decode() == fields["warc-block-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response":
        intact &= hashlib.sha1(payload).hexdigest() == digest and len(payload) == length
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"), "payload_bytes": length,
            "payload_digest": digest, "payload": payload if kind == "response" else None, "intact": intact}


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in manifest.path, one row each; a task streams through a few whole archives.

    Raises on a record that is cut short or isn't framed as it says; `intact` is false where a digest differs.
    """
    schema = SCHEMA if payloads else SCHEMA.replace("payload binary, ", "")
    names = [x.split()[0] for x in schema.split(", ")]
    target = pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, local = opened(path)
                with system.open_input_stream(local, compression=None) as stream:
                    rows, held = [], 0
                    for data in members(stream):
                        rows.append(parse(data))
                        held += len(data)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], target)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], target)

    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), 4096)), "path").mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), scratch(spark))
    out = read(manifest, payloads=False)
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's digest differs")))
    return out.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
