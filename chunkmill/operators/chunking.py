"""Cutting streams: fixed blocks in DataFrame operations, sliding matches in one pass over a stream's bytes."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import crypto, window_digests

#: Sizes in bytes: a chunk at most, and below which a piece stays in the manifest.
CHUNK, INLINE = 65_536, 128
#: The filter of known blocks: bits a block, and at most 2 ** MOST_BITS; fixed odd multipliers.
PER_BLOCK, MOST_BITS = 16, 30
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def fixed_pieces(streams: DataFrame, size: int = CHUNK) -> DataFrame:
    """(stream_id, session, seq, offset, size, bytes): blocks of `size` bytes and a remainder; an empty stream has none."""
    n = F.octet_length("payload")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cut = streams.select("stream_id", "session", "payload", F.posexplode(starts).alias("seq", "offset"))
    piece = F.substring(F.col("payload"), F.col("offset") + 1, F.lit(size))
    return cut.select("stream_id", "session", "seq", F.col("offset").cast("long").alias("offset"), F.octet_length(piece).alias("size"), piece.alias("bytes"))


def instructions(pieces: DataFrame, inline: int = INLINE) -> DataFrame:
    """(stream_id, session, seq, offset, size, crypto, inline): a chunk reference, or the bytes of a small piece."""
    chunk = F.col("size") >= inline
    return pieces.select("stream_id", "session", "seq", "offset", "size", F.when(chunk, crypto(F.col("bytes"))).alias("crypto"), F.when(~chunk, F.col("bytes")).alias("inline"))


def cut_instructions(pieces: DataFrame) -> DataFrame:
    """instructions() of sliding_pieces(): what is inline was decided by the cut."""
    return pieces.select("stream_id", "session", "seq", "offset", "size", "crypto", F.when(F.col("crypto").isNull(), F.col("bytes")).alias("inline"))


class Slider:
    """The sliding cut of one stream after another against the blocks known so far.

    A window of exactly `size` bytes is looked up at every position, first by its rolling digest, then by SHA-1. On a
    hit what is pending goes out, then the reference; on a miss the oldest byte becomes pending, and a full pending
    block is stored before the next look-up. At the end a full block and a remainder are cut without a look-up.
    """

    def __init__(self, known: set[tuple[int, bytes]], size: int, inline: int):
        self.size, self.inline = size, inline
        self.known: dict[int, set[bytes]] = {}
        self.learn(known)

    def learn(self, known: Iterable[tuple[int, bytes]]) -> None:
        for digest, sha in known:
            self.known.setdefault(digest, set()).add(sha)

    def cut(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in order: ref for a block that was known, new for one that is stored, inline."""
        m, n, out = self.size, len(data), []
        digests = window_digests(data, m)
        snapshot = np.fromiter(self.known, np.uint64, len(self.known))
        # positions worth a look, smallest first: only these are hashed, all bytes between them are passed over at once
        look = np.flatnonzero(np.isin(digests, snapshot)).tolist() if len(snapshot) and len(digests) else []
        order = np.argsort(digests, kind="stable")
        by_digest = digests[order]

        def store(a: int, b: int) -> None:
            if b - a < self.inline:
                out.append(("inline", a, b))
                return
            out.append(("new", a, b))
            if b - a == m:
                d = digests[a]
                if int(d) not in self.known:
                    for at in order[np.searchsorted(by_digest, d) : np.searchsorted(by_digest, d, "right")].tolist():
                        heapq.heappush(look, at)
                self.known.setdefault(int(d), set()).add(hashlib.sha1(data[a:b]).digest()[:16])

        pending = at = 0  # bytes from `pending` to `at` wait, the window begins at `at`
        while at + m <= n:
            while look and look[0] < at:
                heapq.heappop(look)
            limit = min(pending + m, n - m + 1)
            if look and look[0] < limit:
                at = heapq.heappop(look)
                if hashlib.sha1(data[at : at + m]).digest()[:16] in self.known.get(int(digests[at]), ()):
                    if at > pending:
                        store(pending, at)
                    out.append(("ref", at, at + m))
                    pending = at = at + m
                    continue
                at += 1
            else:
                at = limit
            if at - pending == m:
                store(pending, at)
                pending = at
        if n - pending > m:
            store(pending, pending + m)
            pending += m
        if n > pending:
            store(pending, n)
        return out


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts: what is made of one part is in memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks(streams: DataFrame, size: int, step: int) -> DataFrame:
    """(digest as a signed long, crypto, stream_id) of the blocks of `size` bytes that begin at every `step`-th byte."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            found, ids, holders = [np.empty(0, np.uint64)], [], []
            for stream, data in zip(batch.column("stream_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                found.append(window_digests(data, size)[::step])
                ids += [hashlib.sha1(data[a : a + size]).hexdigest()[:32] for a in range(0, len(data) - size + 1, step)]
                holders += [stream] * len(found[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids, pa.string()), pa.array(holders, pa.int64())], ["digest", "crypto", "stream_id"])

    return streams.select("stream_id", "payload").mapInArrow(rows, "digest long, crypto string, stream_id long")


def _places(digests: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each digest among 2 ** bits."""
    return np.stack([digests * m >> np.uint64(64 - bits) for m in _MULTIPLIERS])


def _filter(known: DataFrame) -> tuple[int, np.ndarray]:
    """Bits and words of a Bloom filter of known digests (long), PER_BLOCK bits a block: set in tasks, joined by OR."""
    bits = int(np.clip(int(known.count() * PER_BLOCK).bit_length(), 12, MOST_BITS))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    found = known.select("digest").mapInArrow(rows, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits, words


def _met(streams: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(stream_id, known: digest, crypto of all known blocks whose digest a window of the stream has).

    Window digests are joined with the known blocks'. A filter keeps most windows that meet none out of the join; it
    has no false misses.
    """
    holder = "holder" in known.columns
    known = known.where("digest is not null").select("digest", "crypto", *["holder"] * holder)
    bits, words = _filter(known)
    held = streams.sparkSession.sparkContext.broadcast(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        for batch in _parts(batches):
            ids, found = [], []
            for stream, data in zip(batch.column("stream_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                digests = window_digests(data, size) if stream is not None else np.empty(0, np.uint64)
                for m in range(2):
                    at = _places(digests, bits)[m]
                    digests = digests[words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0]
                digests = np.unique(digests)
                ids.append(np.full(len(digests), stream if len(digests) else 0, np.int64))
                found.append(digests.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], ["stream_id", "digest"])

    windows = streams.select("stream_id", "payload").mapInArrow(rows, "stream_id long, digest long")
    met = windows.join(known, "digest")
    if holder:
        met = met.where("holder < stream_id")
    return met.groupBy("stream_id").agg(F.collect_set(F.struct("digest", F.unhex("crypto").alias("crypto"))).alias("known"))


def sliding_pieces(streams: DataFrame, known: DataFrame | None = None, size: int = CHUNK, inline: int = INLINE, exact: bool = False) -> DataFrame:
    """(stream_id, session, seq, kind, offset, size, crypto, bytes): sliding cuts of every stream.

    Against the blocks of `known` (digest, a signed long, and crypto; full blocks only) and those of the same stream: streams are cut in
    parallel, each with the known blocks that its windows' digests meet in a join. If known has `holder`, a block is
    known to streams of greater stream_id only. exact: also against those of all smaller stream_ids, in one ordered
    task, for small inputs.
    """
    ordered = streams.select("stream_id", "session", "payload")
    # counted, put into the filter and joined: made once
    known = known.persist(StorageLevel.DISK_ONLY) if known is not None else None
    if known is None or known.isEmpty():
        ordered = ordered.withColumn("known", F.lit(None).cast("array<struct<digest: bigint, crypto: binary>>"))
    else:
        ordered = ordered.join(_met(streams, known, size), "stream_id", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slider = Slider(set(), size, inline)
        for batch in _parts(batches):
            out = []
            for stream, session, data, blocks in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "session", "payload", "known")), strict=True):
                if not exact:
                    slider = Slider(set(), size, inline)
                slider.learn((x["digest"] % 2**64, x["crypto"]) for x in blocks or ())
                for seq, (kind, a, b) in enumerate(slider.cut(data)):
                    out.append((stream, session, seq, kind, a, b - a, None if kind == "inline" else hashlib.sha1(data[a:b]).hexdigest()[:32], data[a:b]))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["stream_id", "session", "seq", "kind", "offset", "size", "crypto", "bytes"])

    if exact:
        ordered = ordered.coalesce(1).sortWithinPartitions("stream_id")
    return ordered.mapInArrow(rows, "stream_id long, session string, seq int, kind string, offset long, size int, crypto string, bytes binary")
