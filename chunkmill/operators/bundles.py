"""Packing chunks into bundles by next fit: a bundle is closed when the next chunk would exceed its payload."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import codec, compress

#: Payload of a bundle in bytes.
PAYLOAD = 2 << 20


def next_fit(sizes: list[int], cap: int, fill: int = 0, bundle: int = 0) -> list[tuple[int, int]]:
    """(bundle, position) of each size; an empty bundle takes a chunk of any size."""
    out, pos = [], 0
    for size in sizes:
        if fill and fill + size > cap:
            bundle, fill, pos = bundle + 1, 0, 0
        out.append((bundle, pos))
        fill, pos = fill + size, pos + 1
    return out


def packed(chunks: DataFrame, order: list, cap: int = PAYLOAD) -> DataFrame:
    """chunks with bundle_id (dense in each session) and pos.

    Every session is one writer: its chunks pass through one task in order, a batch at a time, so memory is bounded;
    only ids and sizes travel, not payloads.
    """
    names = chunks.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, bundle, fill, pos = None, 0, 0, 0
        for batch in batches:
            ids, places = [], []
            for own, size in zip(batch.column("session").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if own != session:
                    session, bundle, fill, pos = own, 0, 0, 0
                if fill and fill + size > cap:
                    bundle, fill, pos = bundle + 1, 0, 0
                ids.append(bundle)
                places.append(pos)
                fill, pos = fill + size, pos + 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.array(ids, np.int64)), pa.array(np.array(places, np.int32))], [*names, "bundle_id", "pos"])

    return chunks.repartition("session").sortWithinPartitions("session", *order).mapInArrow(rows, f"{schema}, bundle_id long, pos int")


def stats(packed_: DataFrame) -> DataFrame:
    return packed_.groupBy("session", "bundle_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("payload"))


def behind(packed_: DataFrame, index: DataFrame) -> DataFrame:
    """Packed chunks with bundle_ids that go on behind the last bundle that the index has of the session."""
    last = index.groupBy("session").agg(F.max("bundle_id").alias("last"))
    return packed_.join(last, "session", "left").withColumn("bundle_id", F.col("bundle_id") + F.coalesce(F.col("last") + 1, F.lit(0))).drop("last")


def stored(packed_: DataFrame, payloads: DataFrame, method: str = "lzma", level: int = 6) -> DataFrame:
    """Bundles with their records and compressed payload; payloads: crypto, bytes."""
    record = F.struct("pos", "crypto", "size")
    rows = packed_.join(payloads.select("crypto", "bytes"), "crypto").groupBy("session", "bundle_id")
    bundles = rows.agg(F.array_sort(F.collect_list(record)).alias("r"), F.expr("listagg(bytes) WITHIN GROUP (ORDER BY pos)").alias("data"))
    records = F.transform("r", lambda x: F.struct(x["crypto"].alias("crypto"), x["size"].alias("size")))
    return bundles.select("session", "bundle_id", F.lit(method).alias("method"), records.alias("records"), compress(F.col("data"), method, level).alias("payload"))


def unpacked(bundles: DataFrame) -> DataFrame:
    """(session, bundle_id, pos, crypto, size, bytes) of stored bundles, each decompressed and sliced once.

    A bundle without a method is of the first version, which knew lzma alone. A payload that is not as long as its
    records say is an error.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for session, bundle, method, records, payload in zip(*(batch.column(c).to_pylist() for c in ("session", "bundle_id", "method", "records", "payload")), strict=True):
                data = codec(method or "lzma")[1](payload)
                sizes = [r["size"] for r in records]
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                if (ends[-1] if ends else 0) != len(data):
                    raise ValueError(f"bundle {bundle} of {session} does not hold what its records say")
                n = len(records)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([session] * n, pa.string()), pa.array([bundle] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([r["crypto"] for r in records], pa.string()), pa.array(sizes, pa.int32()), pa.array([data[e - k : e] for e, k in zip(ends, sizes, strict=True)], pa.binary())],
                    ["session", "bundle_id", "pos", "crypto", "size", "bytes"],
                )

    return bundles.select("session", "bundle_id", "method", "records", "payload").mapInArrow(rows, "session string, bundle_id long, pos int, crypto string, size int, bytes binary")
