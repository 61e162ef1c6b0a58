import random
from functools import reduce

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from chunkmill.functions import hashing
from chunkmill.operators import restore
from chunkmill.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    found = got.collect()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, found) == rows(want.columns, want.fetchall())
    else:
        assert found


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_adler_by_hand(spark):
    import zlib

    texts = {r.doc_id: r.text for r in catalogue.read(spark, SMALL, "documents").collect()}
    for r in catalogue.adler32_check(spark, SMALL).collect():
        assert r.adler32 == zlib.adler32(texts[r.stream_id].encode())


def test_sliding_pieces_cover_streams(spark):
    total = {}
    for r in catalogue.sliding_dedup(spark, SMALL).collect():
        total[r.stream_id] = total.get(r.stream_id, 0) + r["size"]
    for r in catalogue.stream_profile(spark, SMALL).collect():
        assert total.get(r.stream_id, 0) == r["size"]


def test_iterated_manifests_restore(spark):
    """The last manifest and its chunks give the first one back, and that gives the stream."""
    texts = {r.stream_id: bytes(r.payload) for r in catalogue.streams(spark, SMALL).collect()}
    rounds = 0
    for r in catalogue.iterated_manifest(spark, SMALL).collect():
        stored = {bytes(c["id"]): bytes(c["bytes"]) for c in r.chunks}
        first = restore.expanded(bytes(r.manifest), r.iterations, stored.__getitem__)
        data = texts[r.stream_id]
        cut = [data[i : i + catalogue.M] for i in range(0, len(data), catalogue.M)]
        assert first == restore.serialized((1, hashing.chunk_id_of(x)) if len(x) >= 128 else (2, x) for x in cut)
        chunks = {hashing.chunk_id_of(x): x for x in cut}
        assert restore.expanded(first, 1, chunks.__getitem__) == data
        assert r.final_size == len(r.manifest) and (len(cut) > 1 or r.iterations == 0)
        rounds += r.iterations
    assert rounds


def test_sliding_finds_as_brute_force(spark):
    """References are what a plain search for known blocks at every offset finds, of items and of earlier documents."""
    items = [r.text.encode() for r in catalogue.read(spark, SMALL, "benchmark").collect()]
    texts = sorted((r.stream_id, bytes(r.payload)) for r in catalogue.streams(spark, SMALL).collect())
    m = min([catalogue.PASSAGE, *(len(x) for x in items if x)])
    fixed = lambda x: {x[i : i + m] for i in range(0, len(x) - m + 1, m)}
    known = {x[i : i + m] for x in items for i in range(len(x) - m + 1)}
    want = set()
    for stream, data in texts:
        own, at, pending = set(), 0, 0
        while at + m <= len(data):
            if data[at : at + m] in known | own:
                if at - pending == m:
                    own.add(data[pending:at])
                want.add((stream, at))
                pending = at = at + m
                continue
            at += 1
            if at - pending == m:
                own.add(data[pending:at])
                pending = at
        known |= fixed(data)
    got = {(r.stream_id, r.offset) for r in catalogue.sliding_dedup(spark, SMALL).where("kind = 'ref'").collect()}
    assert got == want and any(offset % m for _, offset in got)


def test_sliding_finds_shifted_copies_and_short_items(spark, tmp_path):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choices("abcdefghij ", k=n))
    first, item = text(640), text(95)
    docs = [(1, "s", first), (2, "s", "+" + first), (3, "t", text(50) + item[7:] + text(50) + item)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.stream_id, r.offset) for r in catalogue.sliding_dedup(spark, str(tmp_path)).where("kind = 'ref'").collect()}
    assert found == {(2, i) for i in range(1, 641, 64)} | {(3, 50), (3, 50 + 88 + 50)}


def test_rolling_digests_of_odd_streams(spark, tmp_path):
    """Repeated and missing ids, null and empty texts, lengths around a block's, code points across its edge."""
    texts = ["", None, "a", "\0", "x" * 255, "y" * 256, "z" * 257, "q" * 512, "a" * 255 + "é€\U0001f600" * 100, "long " * 20_000]
    docs = [*enumerate(texts), (3, "again"), (None, "w" * 300), (-1, "negative")]
    spark.createDataFrame([(i, "s", x) for i, x in docs], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda data: reduce(lambda a, x: (a * 257 + x) % 2**64, data, 1)
    want = [(i, seq, f"{fold(data[at : at + catalogue.M]):016x}") for i, x in docs for data in [(x or "").encode()] for seq, at in enumerate(range(0, len(data), catalogue.M))]
    found = catalogue.rolling_digest(spark, str(tmp_path))
    assert [(f.name, f.dataType.typeName()) for f in found.schema] == [("stream_id", "long"), ("seq", "integer"), ("digest", "string")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_rolling_digest_gives_python_a_block_alone(spark):
    """No row that goes to Python has its stream's payload, which would be there once for each block."""

    def given(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        own = [(node.nodeName(), {x.output().apply(i).name() for i in range(x.output().size())}) for x in children] if "Arrow" in node.nodeName() else []
        return own + [names for x in children for names in given(x)]

    assert given(catalogue.rolling_digest(spark, SMALL)._jdf.queryExecution().optimizedPlan()) == [("MapInArrow", {"stream_id", "seq", "bytes"})]
