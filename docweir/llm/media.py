"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG, 576 samples wide, a member of a tar shard named by the payload's digest.
Rows carry the digest and the member's shard, offset and length; equal payloads are stored once in a shard, and all
rows of a digest point to one place. Metadata columns come from range reads of the image's first 33 bytes, features
from the stored bytes read back. Shards are written below the shared folder through a filesystem handle for its URI,
under names that no other attempt of a task uses: what a lost task leaves is never referred to.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import batch, id_text, lookup, ready, shared_dir, slices, staged

UNIT = 576
#: A shard is closed beyond so many bytes.
SHARD = 256 << 20
#: Bytes of a shard that a task reads, about.
STRETCH = 16 << 20
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    """The text's bytes, and bytes 255 up to a positive multiple of 576."""
    raw = text.encode()
    return raw + b"\xff" * ((-len(raw)) % UNIT if raw else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from an image's first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(data: bytes) -> bytes:
    """The samples, with every chunk's checksum verified."""
    width, height, depth, colour = read_header(data[:HEADER])
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def _open(folder: str):
    """(filesystem, path) of a folder's URI."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where, path


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """(doc_id, digest, n_bytes, shard, offset, length): where each row's payload is stored. Runs when it is written.

    Null text counts as empty (one unit of bytes 255); repeated rows and equal texts have equal digests; an empty
    table writes no shard.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        out, name, at, known = None, "", 0, {}
        where, path = None, ""
        try:
            for b in slices(batches):
                rows = []
                for text in b.column(1).to_pylist():
                    payload = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in known:
                        if out is not None and at > shard_bytes:
                            out.write(b"\0" * 1024)
                            out.close()
                            out = None
                        if out is None:
                            if where is None:
                                where, path = _open(folder)
                            name, at, known = f"{uuid.uuid4().hex}.tar", 0, {}
                            out = where.open_output_stream(f"{path}/{name}")
                        data = to_png(payload)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(data)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head)
                        out.write(data)
                        out.write(b"\0" * (-len(data) % 512))
                        known[digest] = (name, at + len(head), len(data))
                        at += len(head) + len(data) + -len(data) % 512
                    rows.append((digest, len(text.encode()), *known[digest]))
                yield batch(schema, b.column(0), *map(list, zip(*rows, strict=True)))
        finally:
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()

    return id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id bigint, digest string, n_bytes bigint, shard string, offset bigint, length bigint")


def places(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): the one place of each digest."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches of places, and a reader of byte ranges for each row; a shard is opened once while rows stay in it."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder)
    name, handle = None, None
    for b in batches:
        reads = []
        for shard, offset, length in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True):
            if shard != name:
                if handle is not None:
                    handle.close()
                name, handle = shard, where.open_input_file(f"{path}/{shard}")
            reads.append((handle.read_at(HEADER, offset), lambda h=handle, n=length, o=offset: h.read_at(n, o)))
            yield b.slice(len(reads) - 1, 1), reads[-1]
    if handle is not None:
        handle.close()


def metadata(at: DataFrame, folder: str) -> DataFrame:
    """places with width, height and bits, filled by range reads of headers; no payload is read."""
    ready(at.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.string()), ("shard", pa.string()), *((n, pa.int64()) for n in ("offset", "length", "width", "height", "bits"))])
        rows = []
        for row, (head, _) in _ranges(batches, folder):
            rows.append((*(c[0].as_py() for c in row.columns), *read_header(head)[:3]))
            if len(rows) >= 1000:
                yield batch(schema, *map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield batch(schema, *map(list, zip(*rows, strict=True)))

    return _in_order(at).mapInArrow(run, "digest string, shard string, offset bigint, length bigint, width bigint, height bigint, bits bigint")


def _in_order(at: DataFrame) -> DataFrame:
    """Places dealt by shard and stretch of 16 MB, so that a task reads forward; as many tasks as there are stretches:
    the rows are few bytes, so their size says nothing of the bytes to be read."""
    stretch = (F.col("offset") / STRETCH).cast("long")
    n = 1 + (at.agg(F.sum("length")).first()[0] or 0) // STRETCH
    return at.select("digest", "shard", "offset", "length").repartition(n, "shard", stretch).sortWithinPartitions("shard", "offset")


def features(at: DataFrame, folder: str) -> DataFrame:
    """Per digest, from the stored bytes: sizes, digests, and a feature text of the samples' figures. The payload's
    own sha256 is the digest: bytes of which it isn't are an error."""
    ready(at.sparkSession)
    kinds = [("digest", pa.string()), ("payload_bytes", pa.int64()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows = pa.schema(kinds), []
        for row, (head, read) in _ranges(batches, folder):
            data = read()
            payload = from_png(data)
            sha = hashlib.sha256(payload).hexdigest()
            if sha != row.column("digest")[0].as_py():
                raise ValueError("stored bytes differ from their digest")
            s = np.frombuffer(payload, np.uint8)
            histogram = ".".join(map(str, np.bincount(s >> 5, minlength=8).tolist()))
            feature = f"{int(s.sum(dtype=np.int64))}:{s.min()}:{s.max()}:{histogram}"
            rows.append((sha, len(payload), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if len(rows) >= 1000:
                yield batch(schema, *map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield batch(schema, *map(list, zip(*rows, strict=True)))

    return _in_order(at).mapInArrow(run, "digest string, payload_bytes bigint, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, **columns) -> DataFrame:
    """Stores all payloads, then returns a row for each document: its place, its metadata's and its bytes' features."""
    folder = f"{shared_dir(docs.sparkSession)}/shards"
    index = staged(write_shards(docs, folder, **columns), "index")
    at = staged(places(index), "places")
    # Columns of the metadata come from headers alone, those of the features from whole payloads.
    got = features(at, folder).join(metadata(at, folder), "digest")
    got = staged(got.withColumn("feature", F.concat_ws(":", F.concat_ws("x", "width", "height", "bits"), "feature")), "features")
    return lookup(index.select("doc_id", "digest", "n_bytes"), got, ["digest"], index.count()).withColumn("payload_sha256", F.col("digest"))


def read_member(folder: str, shard: str, offset: int, length: int) -> bytes:
    """One stored image, by its place."""
    where, path = _open(folder)
    with where.open_input_file(f"{path}/{shard}") as f:
        return f.read_at(length, offset)


def list_shard(folder: str, shard: str) -> list[tuple[str, int, int]]:
    """(digest, offset, length) of a shard's members, as any tar reader sees them."""
    where, path = _open(folder)
    with where.open_input_stream(f"{path}/{shard}") as f:
        with tarfile.open(fileobj=io.BytesIO(f.read())) as t:
            return [(m.name.removesuffix(".png"), m.offset_data, m.size) for m in t]
