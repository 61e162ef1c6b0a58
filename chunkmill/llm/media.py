"""Media columns: content-addressed payloads in tar shards, with digest, offset and length in the rows.

A text's bytes, padded, become the samples of an 8-bit grey PNG image (lossless), stored under the text's digest.
Payloads are written where they are read, without a shuffle: a task stores a text once, and of the tasks' copies one
is chosen that all rows refer to. Shards are tar files of bounded size in the shared folder, named by partition and
number; each gets its name when it is complete, so that a repeated task replaces a shard by an equal one. Metadata
columns come from range reads of the images' headers alone, the other columns from reading the stored range back; a
shard is opened once and read in the order of its offsets.

Defined cases: null and empty texts are one padding block; equal texts share one stored image; rows without doc_id or
that repeat one are rows like others; ties cannot be, as a digest's place is the smallest; texts of any length are
stored whole; an empty table gives no rows; extra columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_exit, map_text, scratch, shared_dir, texts

#: Padding byte and unit, image width, bytes of a PNG's signature and header chunk.
PAD, UNIT, WIDTH, HEADER, SIGNATURE = b"\xff", 576, 576, 33, b"\x89PNG\r\n\x1a\n"
#: Bytes of a shard, digests that a task remembers.
SHARD, REMEMBERED = 64 << 20, 1_000_000


def payload(data: bytes) -> bytes:
    return data + PAD * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image(samples: bytes) -> bytes:
    """A PNG file of WIDTH columns, one byte a sample."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(lines), WIDTH + 1), np.uint8)
    filtered[:, 1:] = lines
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from a PNG's first HEADER bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", start[16:25])


def samples(stored: bytes) -> bytes:
    """The samples of an image() file."""
    at, data = 8, []
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        if stored[at + 4 : at + 8] == b"IDAT":
            data.append(stored[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are written here")
    return lines[:, 1:].tobytes()


def feature(width: int, height: int, x: np.ndarray) -> str:
    """Size, mean, deviation and a histogram of 16 bins in 255ths of the largest."""
    bins = np.bincount(x >> 4, minlength=16)
    return f"{width}x{height};mean={x.mean():.4f};std={x.std():.4f};hist={(bins * 255 // bins.max()).astype(np.uint8).tobytes().hex()}"


class Shards:
    """Writes members to tar files of bounded size in a folder that every executor can reach."""

    def __init__(self, folder: str, task: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root)
        self.out, self.task, self.number, self.name, self.at, self.written = None, task, 0, "", 0, ""

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > SHARD:
            self.close()
            self.name, self.number, self.at = f"{self.task:07d}-{self.number:05d}.tar", self.number + 1, 0
            self.written = f"{self.root}/{self.name}.{uuid.uuid4().hex}"
            self.out = self.files.open_output_stream(self.written)
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        place = self.at + len(head)
        block = head + data + bytes(-len(data) % tarfile.BLOCKSIZE)
        self.out.write(block)
        self.at += len(block)
        return self.name, place, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None
            self.files.move(self.written, f"{self.root}/{self.name}")


def stored(documents: DataFrame, folder: str) -> DataFrame:
    """Writes the shards; (digest, shard, offset, length) of the stored copy of every distinct text that rows refer to."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen, out = Shards(folder, TaskContext.get().partitionId()), set(), []
        for batch in batches:
            for text in texts(batch):
                data = text.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(data).digest()
                if digest not in seen:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    out.append((digest, *shards.add(f"{digest.hex()}.png", image(payload(data)))))
        shards.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.string(), pa.int64(), pa.int64()))], ["digest", "shard", "offset", "length"])

    places = scratch(map_text(documents.select("text"), rows, "digest binary, shard string, offset long, length long"), "media")
    return places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """Every place with what its header alone tells (width, height), and what the stored range holds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name, shard = None, None
        for batch in batches:
            out = []
            for where, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if where != name:
                    if shard:
                        shard.close()
                    name, shard = where, files.open_input_file(f"{root}/{where}")
                width, height, _ = header(shard.read_at(HEADER, offset))
                whole = shard.read_at(length, offset)
                data = samples(whole)
                out.append((width, height, len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-32:]), hashlib.sha256(whole).digest(), feature(width, height, np.frombuffer(data, np.uint8))))
            found = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], [*names, "width", "height", "payload_bytes", "payload", "tail_crc32", "media", "feature"])

    names = ["digest", "shard", "offset", "length"]
    # a shard's rows meet in a task, in the order in which they are stored
    ordered = places.select(names).repartition("shard").sortWithinPartitions("shard", "offset")
    return map_text(ordered, rows, "digest binary, shard string, offset long, length long, width int, height int, payload_bytes long, payload binary, tail_crc32 long, media binary, feature string")


def media_columns(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the columns of the stored media of every row, with its place (shard, offset, length)."""
    folder = f"{shared_dir(documents.sparkSession)}/media-{uuid.uuid4().hex}"
    known = scratch(read_back(stored(documents, folder), folder), "read-back")
    for_exit(documents.sparkSession, folder)
    digest, hexed = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), lambda c, name: F.lower(F.hex(c)).alias(name)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest"))
    columns = ["payload_bytes", hexed("payload", "payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), hexed("media", "media_sha256"), "feature", hexed("digest", "digest"), "shard", "offset", "length", "width", "height"]
    return rows.join(known, "digest").select("doc_id", "n_bytes", *columns)
