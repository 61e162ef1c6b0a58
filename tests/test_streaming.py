import hashlib
import random

from chunkmill.streaming import run_sessions, session_writer

STREAMS = "stream_id long, session string, payload binary"


def test_sessions_add_only_new_chunks(spark, tmp_path):
    block = bytes(range(256))
    inbox, root = str(tmp_path / "in"), str(tmp_path / "repo")
    spark.createDataFrame([(1, "s", block + block[::-1])], STREAMS).write.parquet(inbox)

    def run():
        run_sessions(spark.readStream.schema(STREAMS).parquet(inbox), root, 256, 1024).awaitTermination()
        return sorted(r.crypto for r in spark.read.parquet(f"{root}/index").collect())

    ids = [hashlib.sha1(x).hexdigest()[:32] for x in (block, block[::-1], b"x" * 256)]
    assert run() == sorted(ids[:2])
    # the next batch holds one known and one new chunk
    second = spark.createDataFrame([(2, "t", block + b"x" * 256)], STREAMS)
    second.write.mode("append").parquet(inbox)
    assert run() == sorted(ids)
    # a batch that is repeated replaces its own part
    session_writer(spark, root, 256, 1024)(second, 1)
    assert sorted(r.crypto for r in spark.read.parquet(f"{root}/index").collect()) == sorted(ids)


def test_sessions_slide_over_inserted_bytes(spark, tmp_path):
    data = random.Random(7).randbytes(2560)
    write = session_writer(spark, str(tmp_path), 256, 1024)
    write(spark.createDataFrame([(1, "s", data)], STREAMS), 0)
    write(spark.createDataFrame([(2, "t", data[:300] + b"!" + data[300:])], STREAMS), 1)
    assert spark.read.parquet(f"{tmp_path}/index").where("batch = 1").count() <= 2
