"""Garbage collection: mark what retained streams use, classify bundles, rewrite what is partly used.

The sources of truth are never changed in place: a collection yields the rows of a new snapshot, which is written
before anything old is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundles import PAYLOAD, packed


def used_chunks(instructions: DataFrame, retained: DataFrame) -> DataFrame:
    """Different chunks that retained streams (stream_id) refer to."""
    return instructions.where("crypto is not null").join(retained.select("stream_id").distinct(), "stream_id", "left_semi").select("crypto").distinct()


def first_sightings(index: DataFrame) -> DataFrame:
    """Index rows with `counts`: whether the row is its chunk's first in the order (session, bundle_id, pos)."""
    place = F.struct("session", "bundle_id", "pos")
    first = index.groupBy("crypto").agg(F.min(place).alias("first"))
    return index.join(first, "crypto").withColumn("counts", place == F.col("first")).drop("first")


def classified(index: DataFrame, used: DataFrame, deep: bool = False, repack: bool = False) -> DataFrame:
    """(session, bundle_id, total, used, action) of each bundle; index: session, bundle_id, pos, crypto, size.

    deep: a chunk counts only where it is seen first. Actions, tested in this order: remove (nothing used of
    something), modify (partly used, or repack), remove (deep: nothing counted), keep.
    """
    rows = (first_sightings(index) if deep else index.withColumn("counts", F.lit(True))).join(used.select("crypto", F.lit(True).alias("is_used")), "crypto", "left")
    bundles = rows.groupBy("session", "bundle_id").agg(F.sum(F.col("counts").cast("long")).alias("total"), F.sum((F.col("counts") & F.coalesce("is_used", F.lit(False))).cast("long")).alias("used"))
    action = F.when((F.col("used") == 0) & (F.col("total") > 0), "remove").when(F.col("used") < F.col("total"), "modify").when(F.lit(repack) & (F.col("total") > 0), "modify").when(F.lit(deep) & (F.col("total") == 0), "remove").otherwise("keep")
    return bundles.withColumn("action", action)


def index_rollup(bundles: DataFrame, concat: bool = False) -> DataFrame:
    """Per index file: chunks and bundles by action, and whether it is written anew, dropped or kept."""
    n = lambda a: F.sum((F.col("action") == a).cast("long"))
    rolled = bundles.groupBy("session").agg(F.sum("total").alias("total"), F.sum("used").alias("used"), n("keep").alias("kept"), n("modify").alias("modified"), n("remove").alias("removed"))
    fate = F.when((F.col("modified") > 0) | (F.col("removed") > 0), "rewritten").when(F.lit(concat), "merged").otherwise("kept")
    return rolled.withColumn("fate", fate)


def rewritten(index: DataFrame, used: DataFrame, cap: int = PAYLOAD, deep: bool = False, repack: bool = False) -> DataFrame:
    """The index after a collection: (session, bundle_id, pos, crypto, size, moved).

    Kept bundles stay as they are; used chunks of modified ones are packed anew, in reverse order of records, behind
    the session's last bundle.
    """
    bundles = classified(index, used, deep, repack)
    rows = index.join(bundles.select("session", "bundle_id", "action"), ["session", "bundle_id"])
    kept = rows.where("action = 'keep'").select("session", "bundle_id", "pos", "crypto", "size", F.lit(False).alias("moved"))
    moving = rows.where("action = 'modify'").join(used, "crypto", "left_semi")
    if deep:
        moving = first_sightings(index).where("counts").select("session", "bundle_id", "pos", "crypto").join(moving, ["session", "bundle_id", "pos", "crypto"])
    last = index.groupBy("session").agg(F.max("bundle_id").alias("last"))
    again = packed(moving.select("session", F.col("bundle_id").alias("old"), F.col("pos").alias("old_pos"), "crypto", "size"), ["old", F.desc("old_pos")], cap)
    again = again.join(last, "session").select("session", (F.col("bundle_id") + F.col("last") + 1).alias("bundle_id"), "pos", "crypto", "size", F.lit(True).alias("moved"))
    return kept.union(again)
