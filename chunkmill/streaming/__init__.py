"""Sessions as micro-batches: each batch registers its new chunks, packs them and appends its index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import rolling_hex, signed
from ..operators import bundles, chunking, index


def session_writer(spark: SparkSession, root: str, chunk: int, cap: int, slide: bool = True):
    """For foreachBatch: appends to root/index. A batch that is repeated after a failure replaces its own part.

    slide: streams are cut by sliding against the index of the batches before and against themselves, else into fixed blocks.
    """
    schema = "session string, bundle_id long, pos int, crypto string, size int, digest long"

    def known(upto: int) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/index")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema + ", batch long").parquet(f"{root}/index").where(f"batch < {upto}")

    def write(streams: DataFrame, batch: int) -> None:
        before = known(batch)
        if slide:
            cut = chunking.sliding_pieces(streams, before.where(F.col("size") == chunk).select("digest", "crypto"), chunk)
            made = chunking.cut_instructions(cut)
        else:
            cut = chunking.fixed_pieces(streams, chunk)
            made = chunking.instructions(cut)
        fresh = index.new_chunks(made.select("crypto", "stream_id", "seq", "session", "size"), before)
        packed = bundles.behind(bundles.packed(fresh, ["stream_id", "seq"], cap), before)
        if slide:
            digests = cut.select("stream_id", "seq", signed(rolling_hex("bytes")).alias("digest")).dropDuplicates(["stream_id", "seq"])
            packed = packed.join(digests, ["stream_id", "seq"])
        else:  # nothing is looked up by digest
            packed = packed.withColumn("digest", F.lit(None).cast("long"))
        packed.select("session", "bundle_id", "pos", "crypto", "size", "digest").write.mode("overwrite").parquet(f"{root}/index/batch={batch}")

    return write


def run_sessions(streams: DataFrame, root: str, chunk: int, cap: int, slide: bool = True) -> StreamingQuery:
    """Processes what a streaming DataFrame of streams (stream_id, session, payload) has to offer, then stops."""
    writer = session_writer(streams.sparkSession, root, chunk, cap, slide)
    return streams.writeStream.foreachBatch(writer).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
