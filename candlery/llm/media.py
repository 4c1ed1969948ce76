"""Media columns: payloads kept once by content in tar shards; rows hold digest, shard, offset and length.

Metadata columns come from range reads of the first bytes of each member, without its body. The payloads here are texts
as greyscale PNG images of 192 samples a row, a lossless form with 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import extended, partitions, scratch, slices, stored, table, with_top
from .files import make_folder, opened

ROW = 192
HEADER_BYTES = 33  # PNG's signature and its IHDR chunk
SHARD_BYTES = 64 << 20
READ_BYTES = 4 << 20
BROADCAST_IDS = 1_000_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: Column) -> Column:
    """UTF-8 of the text (null: empty), filled up with spaces to a positive multiple of 192 bytes."""
    text = F.coalesce(text, F.lit(""))
    fill = F.when(F.octet_length(text) == 0, ROW).otherwise(F.pmod(-F.octet_length(text), F.lit(ROW)))
    return F.concat(text, F.repeat(F.lit(" "), fill)).cast("binary")


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 5) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # a leading 0: no filter
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("no PNG image")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    if colour or bits != 8:
        raise ValueError("not 8-bit greyscale")
    return width, height, bits


def from_png(media: bytes) -> bytes:
    width, height, _ = png_header(media[:HEADER_BYTES])
    at, body = HEADER_BYTES, []
    while True:
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IEND":
            break
        if kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a PNG filter that isn't written here")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Rows, sum, least, most, sum of steps between neighbours, and a histogram of 8 bins; whole numbers only."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"{len(x) // ROW}:{int(x.sum(dtype=np.int64))}:{x.min()}:{x.max()}:{int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))}:" + ",".join(map(str, bins))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the payload's digest of each row."""
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(payload_of(F.col("text")), 256).alias("digest"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """digest and text of each text's row with the least doc_id, without moving texts while copies are few.

    The other rows' ids and digests are broadcast up to BROADCAST_IDS of them (about 100 bytes each); beyond that the
    rows are joined by a shuffle. Rows that repeat a doc_id, or have none, may come through more than once; store()
    keeps one place for each digest.
    """
    owners = with_top(keyed(docs).select("doc_id", "digest"), ["digest"], "doc_id", "owner", F.min)
    copies = stored(owners.where("doc_id > owner").select("doc_id", "digest"))
    few = copies.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select("doc_id", "text", F.sha2(payload_of(F.col("text")), 256).alias("digest"))
    return rows.join(F.broadcast(copies) if few else copies, ["doc_id", "digest"], "left_anti").select("digest", "text")


def store(texts: DataFrame, folder: str) -> DataFrame:
    """Writes the media of (digest, text) rows into tar shards in folder; returns digest, shard, offset, length, stored.

    Each task writes shards of its own under fresh names, and only a successful task's enter the manifest, so retries
    do no harm.
    """
    make_folder(folder)

    def run(batches):
        out, shard, at, seen = None, None, 0, set()
        for batch in slices(batches):
            rows = []
            for digest, text in zip(*(batch.column(c).to_pylist() for c in ("digest", "text"))):
                if digest in seen:
                    continue
                seen.add(digest)
                data = to_png(pad((text or "").encode()))
                if out is None:
                    shard, at = f"{folder}/{uuid.uuid4().hex}.tar", 0
                    system, local = opened(shard)
                    out = system.open_output_stream(local, compression=None)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(data)
                out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % 512))
                rows.append((digest, shard, at + 512, len(data)))
                at += 512 + len(data) + -len(data) % 512
                if at >= SHARD_BYTES:
                    out.write(b"\0" * 1024)
                    out.close()
                    out = None
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    places = stored(texts.mapInArrow(run, "digest string, shard string, offset long, length long"))
    return stored(places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*"))


def _reading(manifest: DataFrame, read, schema: str) -> DataFrame:
    """manifest's columns and read(file, offset, length) -> values of each row; neighbours in a shard are read in turn."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    new = [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
    kept = [c for c in manifest.columns if c not in dict(new)]

    def run(batches):
        for batch in batches:
            rows, name, file = [], None, None
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != name:
                    if file is not None:
                        file.close()
                    system, local = opened(shard)
                    name, file = shard, system.open_input_file(local)
                rows.append(read(file, offset, length))
            if file is not None:
                file.close()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(new))], names=[*kept, *dict(new)])

    manifest = manifest.select(*kept)
    return manifest.mapInArrow(run, extended(manifest, schema))


def in_reading_order(manifest: DataFrame) -> DataFrame:
    """Members dealt out by stretches of their shards, in the order in which they lie there."""
    part = F.floor(F.col("offset") / READ_BYTES)
    return manifest.repartition(partitions(manifest.sparkSession), "shard", part).sortWithinPartitions("shard", "offset")


def metadata(manifest: DataFrame) -> DataFrame:
    """manifest with width, height and bits of each member, from range reads of 33 bytes."""
    return _reading(manifest, lambda file, offset, length: png_header(file.read_at(HEADER_BYTES, offset)), "width int, height int, bits int")


def features(manifest: DataFrame) -> DataFrame:
    """manifest with what the stored bytes of each member give: sizes, digests of media and payload, and the feature."""

    def read(file, offset, length):
        media = file.read_at(length, offset)
        payload = from_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)

    return _reading(manifest, read, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def columns(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest): doc_id, n_bytes and digest of each row of docs; digest, shard, offset, length, width, height
    and bits of each payload, the last three from header-only range reads.

    Texts are stored once by content. Null and empty texts are 192 spaces; repeated rows stay, and rows that share a
    doc_id but not the text have each their own digest.
    """
    manifest = store(one_of_each(docs.select("doc_id", "text")), folder)
    return keyed(docs), metadata(in_reading_order(manifest))


def with_media(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with the columns that known has for their digest; a digest that known lacks is an error.

    A hot digest is split by Spark's skew join: both sides come to the join straight from their exchange.
    """
    there = F.coalesce("shard", F.raise_error(F.lit("a payload is not in the store")).cast("string"))
    return rows.join(known, "digest", "left").withColumn("shard", there)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """columns(), with what the stored bytes give; see there for null, empty and repeated rows."""
    rows, manifest = columns(table(spark, sf_dir, "documents"), scratch(spark))
    return with_media(rows, features(manifest))
