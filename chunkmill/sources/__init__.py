"""Where streams come from and where repositories' tables go."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where it is unset, for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return root or f"file://{tempfile.mkdtemp()}"


def text_streams(table: DataFrame, key: str = "doc_id", text: str = "text", session: str | None = "source") -> DataFrame:
    """Rows of a table as streams: (stream_id, session, path, payload). Null texts are empty streams."""
    name = F.coalesce(F.col(session), F.lit("")) if session else F.lit("")
    return table.select(F.col(key).cast("long").alias("stream_id"), name.alias("session"), F.concat(name, F.lit("/"), F.col(key).cast("string")).alias("path"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("payload"))


def file_streams(spark: SparkSession, path: str, min_size: int = 0, recursive: bool = True, glob: str | None = None, tolerant: bool = False) -> DataFrame:
    """Regular files below a path as streams; whole directories are listed by Spark, special files are not.

    relative: what stands behind the path. tolerant: files that are gone or cannot be read meanwhile are passed over.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if tolerant:
        reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    # the size is the source's own column: small files are left out before they are read
    return files.where(F.col("length") >= min_size).select(F.xxhash64("path").alias("stream_id"), F.element_at(F.split("path", "/"), -2).alias("session"), "path", F.substring_index("path", f"/{root}/", -1).alias("relative"), F.col("content").alias("payload"))


def min_size(streams: DataFrame, least: int) -> DataFrame:
    """Only streams of at least so many bytes (10 MiB is the usual bound for directories)."""
    return streams.where(F.octet_length("payload") >= least)


def write_table(df: DataFrame, path: str, mode: str = "error", partition: str | None = None) -> None:
    """Commits all files of a write at once (temporary names, then renames); refuses an existing table by default."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def spread_bundles(bundles: DataFrame) -> DataFrame:
    """Adds the folder of a bundle: the first two digits of its name."""
    return bundles.withColumn("folder", F.substring(F.sha1(F.concat_ws("/", "session", F.col("bundle_id").cast("string"))), 1, 2))


def write_list(paths: DataFrame, out: str) -> None:
    """One path a line."""
    paths.select(F.col("path").cast("string")).write.text(out)
