"""Media columns: content-addressed images in tar shards, rows that point into them, header-only range reads."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.bpe import slices
from lamella.llm.common import py, settle, shared_path, table

#: Samples of an image row; payloads are padded to a positive multiple of it.
WIDTH = 64
#: A task starts another shard after so many bytes.
SHARD_BYTES = 256 << 20
LEVEL = 4
#: Digests that a task remembers to store equal payloads once a shard, and results remembered while reading.
MEMORY = 200_000
#: Bytes of stored images that a reading task takes, on average.
READ_BYTES = 32 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes up to the end of the image header: all that metadata columns need.
HEADER = 8 + 8 + 13


def padded(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes, payload): the text's bytes with zeros appended up to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A lossless 8-bit grey PNG, WIDTH samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def image_size(head: bytes) -> tuple[int, int]:
    """(width, height) from the first HEADER bytes of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image header")
    return struct.unpack(">II", head[16:24])


def from_image(image: bytes) -> bytes:
    """The payload of an image that ``to_image`` made."""
    width, height = image_size(image)
    at, data = 8, []
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't written here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples in hundredths, and 64 bits: which of 64 equal stretches are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    sums = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64)
    sizes = np.diff(np.r_[np.arange(64) * len(x) // 64, len(x)])
    bits = sums * len(x) > int(x.sum(dtype=np.int64)) * sizes
    return f"{round(float(x.mean()) * 100)}-{round(float(x.std()) * 100)}-{np.packbits(bits).tobytes().hex()}"


class _Shard:
    """One tar file of a task attempt; its name is its own, so attempts never meet."""

    def __init__(self, folder: str):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.tar"
        self.uri, self.out, self.at = f"{folder}/{name}", store.open_output_stream(f"{path}/{name}"), 0
        self.offsets: dict[bytes, tuple[int, int]] = {}

    def put(self, digest: bytes, data: bytes) -> tuple[int, int]:
        """(offset, length) of the member's bytes, written once."""
        if digest not in self.offsets:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
            self.offsets[digest] = (self.at + 512, len(data))
            self.out.write(data + bytes(-len(data) % 512))
            self.at += 512 + len(data) + -len(data) % 512
        return self.offsets[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads of texts (doc_id, text) as images into tar shards under ``folder``, a URI all executors share.

    Returns doc_id, n_bytes, digest (SHA-256 of the payload), shard, offset, length. Equal payloads in
    a shard are stored once, under their digest, so a hot text costs one member a shard. Read the result
    from a settled table only: each computation writes shards of its own names, and those of lost attempts
    are never pointed to.
    """
    names = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"]

    def run(batches):
        shard = None
        try:
            for part in slices(batches, "text"):
                rows = []
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if shard is None or shard.at > SHARD_BYTES or len(shard.offsets) > MEMORY:
                        if shard is not None:
                            shard.close()
                        shard = _Shard(folder)
                    n, payload = padded(t)
                    digest = hashlib.sha256(payload).digest()
                    at = shard.offsets.get(digest) or shard.put(digest, to_image(payload))
                    rows.append((i, n, digest.hex(), shard.uri, *at))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        finally:
            if shard is not None:
                shard.close()

    return py(docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def _reader():
    """Range reads by (shard, offset, length); one shard is open at a time."""
    held: dict[str, object] = {}

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in held:
            for f in held.values():
                f.close()
            held.clear()
            store_, path = fs.FileSystem.from_uri(shard)
            held[shard] = store_.open_input_file(path)
        return held[shard].read_at(length, offset)

    return read


def with_sizes(index: DataFrame) -> DataFrame:
    """``index`` with width and height, from range reads of the image headers alone."""

    def run(batches):
        read, known = _reader(), {}
        for b in batches:
            out = []
            for key in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist()):
                if key not in known:
                    if len(known) > MEMORY:
                        known.clear()
                    known[key] = image_size(read(*key, HEADER))
                out.append(known[key])
            yield b.append_column("width", pa.array([x[0] for x in out], pa.int32())).append_column("height", pa.array([x[1] for x in out], pa.int32()))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return py(index.sparkSession, index, run, f"{names}, width int, height int")


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def read_back(index: DataFrame) -> DataFrame:
    """Read the stored images of ``index`` (digest, shard, offset, length, ...) and describe image and payload beside its columns."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        read = _reader()
        for b in batches:
            out = []
            for key in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()):
                image = read(*key)
                payload = from_image(image)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)]], [*b.schema.names, *NAMES])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return py(index.sparkSession, index, run, f"{names}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def addresses(index: DataFrame) -> DataFrame:
    """One place for each digest, whichever shards hold it, dealt to tasks by the bytes of the images and in the order in which they lie."""
    size = index.agg(F.sum("length")).first()[0] or 0
    at = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")
    return at.repartitionByRange(max(1, size // READ_BYTES), "shard", "offset")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store texts as images in tar shards of the shared folder, and read each distinct payload back by ranges.

    Returns for each row doc_id, n_bytes, digest, shard, offset, length, width, height and what ``read_back`` tells. Null and
    empty texts are one row of zeros; equal payloads are stored once a shard and addressed by one place,
    so equal texts get equal values; rows that repeat a doc_id are stored and returned each; an empty table gives an empty one.
    """
    folder = shared_path(docs.sparkSession, "media")
    index = settle(store(docs, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"), "media-index")
    described = settle(read_back(with_sizes(addresses(index))), "media-columns")
    return index.select("doc_id", "n_bytes", "digest").join(described, "digest")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as an image, described from what was stored."""
    return media_columns(table(spark, sf_dir, "documents", "doc_id", "text"))
