"""What the operators share: tables, scratch storage, hashing and Arrow plumbing."""

from __future__ import annotations

import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of text that a function sees at a time; a whole Arrow batch is a lot for long texts.
TEXT_BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one where it is unset, which only a local master may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        root = spark.conf.get("chunkmill.local.dir", None)
        if not root:
            root = f"file://{tempfile.mkdtemp(prefix='chunkmill-')}"
            spark.conf.set("chunkmill.local.dir", root)
            for_exit(spark, root)
    return root


def for_exit(spark: SparkSession, path: str) -> None:
    """Has the folder deleted when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, lost executors cost nothing. It is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spare(columns: Iterable[str], name: str) -> str:
    """The name, longer by as many marks as keep it from clashing with columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns what a task has freed to the system; else an idle worker keeps most of it, beside the JVM and other workers."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def map_text(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over parts of batches: what is made of one part is in memory at a time."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                yield batch.slice(at, TEXT_BATCH_ROWS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(parts(batches))
        give_back()

    return df.mapInArrow(task, schema)


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of a bounded object, class and all; the result fetches it on an executor."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


#: A filter's bits for each value, and the logarithm of the most bits that it may have (16 MB); fixed odd multipliers.
PER_VALUE, MOST_BITS = 16, 27
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def filter_of(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A Bloom filter of a column of longs, set in tasks, joined by OR and broadcast: from longs to which of them may be there."""
    bits = int(np.clip((ids.count() * PER_VALUE).bit_length(), 12, MOST_BITS))

    def places(x: np.ndarray) -> np.ndarray:
        return np.stack([x.view(np.uint64) * m >> np.uint64(64 - bits) for m in _MULTIPLIERS])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    found = ids.mapInArrow(rows, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2 ** (MOST_BITS - 6) rows
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    held = ids.sparkSession.sparkContext.broadcast(words)

    def passes(x: np.ndarray) -> np.ndarray:
        at = places(x)
        return (held.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(0)

    return passes


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of strings, null as the empty one."""
    return [x or "" for x in batch.column(name).to_pylist()]


def fold(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the id as text, by which rows are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


class WordHashes(dict):
    """64-bit hash of a word's bytes; forgets everything when it grows beyond its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_shingles(text: str, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words of a text.

    A-Z are lower-cased, words end at the bytes 9-13 and 32. Fewer words make one run; none make an empty set.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        # the count goes in, so that a short text never equals a run of the full width
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes() + bytes([len(h)]))], np.uint64)
    total = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    total = mix(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def jaccard_at_least(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """100 * intersection >= per_cent * union, over sorted distinct arrays; empty sets are like nothing."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < per_cent * len(large):
        return False
    every = np.concatenate((a, b))
    every.sort()
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return 100 * both >= per_cent * (len(a) + len(b) - both)
