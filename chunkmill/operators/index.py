"""The chunk index: first registration wins, look-ups are joins.

Chunks are told apart by their truncated SHA-1: equal ones have equal bytes, hence equal rolling digests, so the
digest is only computed where a chunk id is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import rolling_hex


def first_wins(chunks: DataFrame) -> DataFrame:
    """One row for each crypto: its size and the first (stream_id, seq, session) that holds it. Pre-aggregated, so hot chunks cost one row a task."""
    best = F.min(F.struct("stream_id", "seq", "session", "size")).alias("first")
    return chunks.where("crypto is not null").groupBy("crypto").agg(best).select("crypto", "first.*")


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """first_wins of what the index does not hold yet."""
    return first_wins(chunks.join(index.select("crypto"), "crypto", "left_anti"))


def hits(chunks: DataFrame, index: DataFrame) -> DataFrame:
    return chunks.join(index.select("crypto"), "crypto", "left_semi")


def misses(chunks: DataFrame, index: DataFrame) -> DataFrame:
    return chunks.where("crypto is not null").join(index.select("crypto"), "crypto", "left_anti")


def located(chunks: DataFrame, packed: DataFrame) -> DataFrame:
    """Chunks with the bundle that holds them; one that is nowhere is an error."""
    from .restore import sure

    found = chunks.join(packed.select("crypto", F.col("session").alias("bundle_session"), "bundle_id", "pos"), "crypto", "left")
    return sure(found, F.col("bundle_id").isNotNull(), F.concat(F.lit("no such chunk: "), F.col("crypto")))


def rolling_collisions(payloads: DataFrame) -> DataFrame:
    """For each rolling digest the number of different chunks (crypto, bytes) that have it."""
    return payloads.select(rolling_hex("bytes").alias("digest"), "crypto").groupBy("digest").agg(F.countDistinct("crypto").alias("chunks"))
