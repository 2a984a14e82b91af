"""Media columns: payloads in tar shards, rows that point at them.

A payload is stored losslessly as an 8-bit grey image (PNG), 64 samples a row. Its name is the digest of the stored
bytes, so a shard holds equal payloads once; a row carries digest, shard, offset and length. Metadata columns
are filled from the image header alone: a range read of the first 33 bytes.

Every task writes shards of its own into the shared folder under a name of its own attempt and hands on rows only
when a shard is complete; the rows are written as a table before anything reads them. A lost executor
repeats its tasks; what an unfinished attempt left is never pointed at.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import materialize, prepare, remember, shared_dir, valid

ROW = 64
SHARD_BYTES = 64 << 20
#: Fixed values of the format: signature, and the length of signature and header chunk together.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
LEVEL = 1


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(max(1, -(-len(data) // ROW)) * ROW - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes) -> bytes:
    """An 8-bit grey image of the payload, 64 samples wide."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)  # each row starts with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from the first 33 bytes."""
    if head[:8] != SIGNATURE:
        raise ValueError("no image at this place")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_image(image: bytes) -> bytes:
    """The payload of an image made by ``to_image``."""
    width, height, _ = read_header(image)
    at, data = 8, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def _file_system(url: str) -> tuple[fs.FileSystem, str]:
    if urlparse(url).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(url).path
    return fs.FileSystem.from_uri(url)


class Shard:
    """A tar file that is written from front to back."""

    def __init__(self, folder: str):
        self.url = f"{folder}/{uuid.uuid4().hex}.tar"
        system, path = _file_system(self.url)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.at, self.places = system.open_output_stream(path), 0, {}

    def put(self, image: bytes) -> tuple[str, int, int]:
        """Digest, offset and length of the image; an image that is there already is not written again."""
        digest = hashlib.sha256(image).hexdigest()
        if digest not in self.places:
            info = tarfile.TarInfo(digest + ".png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            body = image + bytes(-len(image) % tarfile.BLOCKSIZE)
            self.places[digest] = self.at + len(head)
            self.out.write(head + body)
            self.at += len(head) + len(body)
        return digest, self.places[digest], len(image)

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, n_bytes, digest, shard, offset, length) for every row: where the padded UTF-8 bytes of its text stand.

    A null text counts as empty, which is stored as 64 zero bytes; bytes that are not UTF-8 are stored as U+FFFD. Repeated rows stay repeated, and all rows of one
    payload point at one place: tasks write what is new to them, and of the places that a digest got the first one by
    shard and offset counts (a payload that several tasks met stands in their shards too, unread). Other
    columns are not read. Runs at once: the rows are a table in the shared folder.
    """
    spark = prepare(docs.sparkSession)
    if folder is None:  # a folder that the caller names is the caller's to delete
        folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
        remember(spark, folder)
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            shard.close()
            yield from waiting
            waiting.clear()

        for batch in batches:
            shard = shard or Shard(folder)
            rows = []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode()
                rows.append((len(data), *shard.put(to_image(pad(data)))))
            n, digest, offset, length = zip(*rows, strict=True) if rows else ((),) * 4
            waiting.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array([shard.url] * len(n), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], schema.names))
            if shard.at >= SHARD_BYTES:
                yield from finish()
                shard = None
        if shard:
            yield from finish()

    written = materialize(docs.select(id_col, valid(text_col)).mapInArrow(run, schema), "media")
    place = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("_place"))
    return written.select(F.struct(id_col).alias("_id"), "n_bytes", "digest").join(place, "digest").select("_id.*", "n_bytes", "digest", "_place.*")


def stored(media: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): every payload once, in the order in which the shards hold them."""
    return media.select("digest", "shard", "offset", "length").distinct().repartition("shard").sortWithinPartitions("shard", "offset")


class Ranges:
    """Range reads; the shard read last stays open."""

    def __init__(self):
        self.url = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.url:
            self.close()
            system, path = _file_system(shard)
            self.url, self.file = shard, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _mapped(media: DataFrame, fields: list[T.StructField], rows_of) -> DataFrame:
    """``media`` with the fields that ``rows_of(ranges, shard, offset, length, digest)`` gives for each row."""
    prepare(media.sparkSession)
    taken = {f.name for f in fields}
    kept = [c for c in media.columns if c not in taken]
    schema = T.StructType([*[media.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            place = [batch.column(kept.index(c)).to_pylist() for c in ("shard", "offset", "length", "digest")]
            made = [rows_of(ranges, *p) for p in zip(*place, strict=True)]
            columns = zip(*made, strict=True) if made else [()] * len(fields)
            target = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in fields])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t.type) for c, t in zip(columns, target, strict=True)]], schema.names)
        ranges.close()

    return media.select(kept).mapInArrow(run, schema)


def with_header(media: DataFrame) -> DataFrame:
    """``media`` with width, height and bits, from the headers alone; columns of these names are replaced."""
    fields = [T.StructField(c, T.IntegerType()) for c in ("width", "height", "bits")]
    return _mapped(media, fields, lambda ranges, shard, offset, length, _: read_header(ranges.read(shard, offset, min(length, HEADER_BYTES))))


def _checked(ranges: Ranges, shard: str, offset: int, length: int, digest: str) -> bytes:
    """The stored bytes; that they are those of their digest is checked."""
    image = ranges.read(shard, offset, length)
    if hashlib.sha256(image).hexdigest() != digest:
        raise ValueError(f"{shard} at {offset} does not hold {digest}")
    return image


def _features(ranges: Ranges, shard: str, offset: int, length: int, digest: str) -> tuple:
    image = _checked(ranges, shard, offset, length, digest)
    payload = from_image(image)
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    entropy = max(0.0, float(-(share * np.log2(share)).sum()))
    feature = f"mean={samples.mean():.4f};max={samples.max()};kinds={len(share)};entropy={entropy:.4f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), digest, feature


def with_features(media: DataFrame) -> DataFrame:
    """``media`` with payload_bytes, payload_sha256, tail_crc32, media_sha256 and feature, from the bytes read back;
    columns of these names are replaced."""
    kinds = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))
    return _mapped(media, [T.StructField(*k) for k in kinds], _features)


def read_payloads(media: DataFrame) -> DataFrame:
    """``media`` with payload, the padded bytes read back; a column of this name is replaced."""
    return _mapped(media, [T.StructField("payload", T.BinaryType())], lambda ranges, *place: (from_image(_checked(ranges, *place)),))


def shard_members(data: bytes) -> list[str]:
    """Names of a shard's members, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return tar.getnames()
