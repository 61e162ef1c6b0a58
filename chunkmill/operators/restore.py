"""Restoring: whole streams with their checksum, ranges of them, and inspection, from instructions and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sure(rows: DataFrame, holds: Column, what: Column) -> DataFrame:
    """The rows, all of which must hold, or an error says what: a condition on rows, which no selection of columns takes away."""
    return rows.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(what).cast("boolean")))


def offsets(instructions: DataFrame) -> DataFrame:
    """Instructions with the offset of what each emits: the running sum of sizes before it."""
    earlier = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return instructions.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("long"))


def emitted(instructions: DataFrame, payloads: DataFrame) -> DataFrame:
    """Instructions with the bytes that they emit; payloads: crypto, bytes. A chunk that is nowhere is an error."""
    found = instructions.join(payloads.select("crypto", F.col("bytes").alias("chunk")), "crypto", "left")
    found = sure(found, F.col("crypto").isNull() | F.col("chunk").isNotNull(), F.concat(F.lit("no such chunk: "), F.col("crypto")))
    return found.withColumn("bytes", F.coalesce("chunk", "inline")).drop("chunk")


def restored(instructions: DataFrame, payloads: DataFrame, streams: DataFrame) -> DataFrame:
    """(stream_id, size, payload, sha256) of every stream of `streams` (stream_id); one without instructions is empty."""
    parts = emitted(instructions, payloads).groupBy("stream_id").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY seq)").alias("payload"))
    whole = streams.select("stream_id").join(parts, "stream_id", "left").withColumn("payload", F.coalesce("payload", F.lit(b"")))
    return whole.select("stream_id", F.octet_length("payload").cast("long").alias("size"), "payload", F.sha2("payload", 256).alias("sha256"))


def verified(restored_: DataFrame, manifests: DataFrame) -> DataFrame:
    """restored() rows; a checksum or size that differs from the manifest's (stream_id, size, sha256) is an error."""
    both = restored_.join(manifests.select("stream_id", F.col("size").alias("n"), F.col("sha256").alias("sha")), "stream_id")
    good = (F.col("size") == F.col("n")) & (F.col("sha256") == F.col("sha"))
    return sure(both, good, F.concat(F.lit("checksum mismatch in stream "), F.col("stream_id").cast("string"))).drop("n", "sha")


def asked_for(instructions: DataFrame, requests: DataFrame) -> DataFrame:
    """The different requests (stream_id, start, length); a range outside of its stream is an error."""
    total = instructions.groupBy("stream_id").agg(F.sum("size").alias("total"))
    sized = requests.select("stream_id", "start", "length").distinct().join(total, "stream_id", "left")
    inside = (F.col("start") >= 0) & (F.col("length") >= 0) & (F.col("start") + F.col("length") <= F.coalesce("total", F.lit(0)))
    return sure(sized, F.coalesce(inside, F.lit(False)), F.lit("out of range")).drop("total")


def met_by(instructions: DataFrame, asked: DataFrame) -> DataFrame:
    """Instructions with their offset, and start and length of each request that they overlap."""
    overlap = (F.col("offset") < F.col("start") + F.col("length")) & (F.col("offset") + F.col("size") > F.col("start"))
    return offsets(instructions).join(asked, "stream_id").where(overlap)


def ranges(instructions: DataFrame, payloads: DataFrame, requests: DataFrame) -> DataFrame:
    """(stream_id, start, length, bytes) of requests (stream_id, start, length); a range outside of its stream is an error.

    Requests that are repeated are each answered. Of the payloads only chunks that a range overlaps are joined.
    """
    asked = asked_for(instructions, requests)
    met = emitted(met_by(instructions, asked), payloads)
    skip = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    take = F.least(F.col("start") + F.col("length") - F.col("offset"), F.col("size")) - skip
    piece = F.substring(F.col("bytes"), (skip + 1).cast("int"), take.cast("int"))
    parts = met.select("stream_id", "start", "length", "seq", piece.alias("piece")).groupBy("stream_id", "start", "length").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY seq)").alias("bytes"))
    answers = asked.join(parts, ["stream_id", "start", "length"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(b"")))
    return requests.select("stream_id", "start", "length").join(answers, ["stream_id", "start", "length"])


def chunk_map(instructions: DataFrame, packed: DataFrame) -> DataFrame:
    """By stream and bundle: how many references it has there, the first offset and the bytes: the order of a bundle-wise restore."""
    from .index import located

    found = located(offsets(instructions).where("crypto is not null"), packed)
    return found.groupBy("stream_id", "bundle_session", "bundle_id").agg(F.count("*").alias("refs"), F.min("offset").alias("first_offset"), F.sum("size").alias("bytes"))


def inspect_fast(streams: DataFrame) -> DataFrame:
    """What a manifest's head tells, without the index."""
    return streams.select("stream_id", F.lit(0).alias("iterations"), F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha256"))


def inspect_deep(instructions: DataFrame, packed: DataFrame) -> DataFrame:
    """The different bundles that each stream needs."""
    return chunk_map(instructions, packed).select("stream_id", "bundle_session", "bundle_id")


def iterated(spark, manifest: bytes, cut, limit: int = 32) -> tuple[list[list], bytes]:
    """Shrinks a serialized manifest by cutting it again until it gets no smaller; cut: bytes -> (instructions, bytes).

    Returns the instructions of each round, innermost last, and the final manifest: a bounded loop on the driver over
    one manifest, not over data.
    """
    rounds = []
    for _ in range(limit):
        found, smaller = cut(manifest)
        if len(smaller) >= len(manifest):
            break
        rounds.append(found)
        manifest = smaller
    return rounds, manifest


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def serialized(pieces: Iterable[tuple[int, bytes]]) -> bytes:
    """A manifest's bytes: its instructions in order, each a length and a field 1 (id of a chunk) or 2 (inline bytes)."""
    fields = (bytes([field << 3 | 2]) + _varint(len(value)) + value for field, value in pieces)
    return b"".join(_varint(len(f)) + f for f in fields)


def parsed(manifest: bytes) -> list[tuple[int, bytes]]:
    """The instructions that serialized() wrote."""
    at, out = 0, []

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte, at = manifest[at], at + 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(manifest):
        number()
        field, at = manifest[at] >> 3, at + 1
        size = number()
        if field not in (1, 2) or at + size > len(manifest):
            raise ValueError("not a manifest")
        out.append((field, manifest[at : at + size]))
        at += size
    return out


def expanded(manifest: bytes, iterations: int, chunk: Callable[[bytes], bytes]) -> bytes:
    """The inverse of iterated(): the first manifest, from the last one and the chunks (by id) that its rounds stored."""
    for _ in range(iterations):
        manifest = b"".join(chunk(value) if field == 1 else value for field, value in parsed(manifest))
    return manifest
