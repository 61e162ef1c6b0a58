import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chunkmill import sources
from chunkmill.functions import codecs, hashing
from chunkmill.operators import bundles, chunking, exchange, gc, index, restore, rules
from chunkmill.plans.repository import Config, Repository


def test_digest_known_values_and_windows():
    assert [hashing.digest(x) for x in (b"", b"\0", b"abc")] == [1, 257, 23406631]
    assert hashing.digest(b"\0" * 3) != hashing.digest(b"\0" * 4)
    data = random.Random(1).randbytes(500)
    windows = hashing.window_digests(data, 37)
    value = hashing.digest(data[:37])
    for i in range(len(data) - 37):
        assert value == int(windows[i]) == hashing.digest(data[i : i + 37])
        value = hashing.rotate(value, data[i], data[i + 37], 37)


def test_columns(spark):
    row = spark.createDataFrame([(b"abc",)], "b binary").select(hashing.adler32("b"), hashing.crypto(F.col("b")), hashing.chunk_id(F.col("b")).alias("id")).first()
    assert row[0] == 38600999 and row[1] == hashlib.sha1(b"abc").hexdigest()[:32]
    assert row["id"] == row[1] + (23406631).to_bytes(8, "little").hex()
    back = spark.createDataFrame([(row["id"],)], "id string").select(*hashing.from_chunk_id(F.col("id"))).first()
    assert tuple(back) == (row[1], f"{23406631:016x}")


def test_sizes():
    assert hashing.parse_size("64KiB") == 65536 and hashing.parse_size("2mb") == 2_000_000
    for bad in ("12", "x", "1tib"):
        with pytest.raises(ValueError):
            hashing.parse_size(bad)


def test_sliding_cut_restores_and_finds():
    draw = random.Random(2)
    for _ in range(400):
        m, inline = draw.choice((3, 4, 6)), draw.choice((1, 2, 3))
        data = bytes(draw.choice(b"ab") for _ in range(draw.randrange(40)))
        known = {(hashing.digest(b), hashlib.sha1(b).digest()[:16]) for b in (data[5 : 5 + m],) if len(b) == m} if draw.random() < 0.5 else set()
        cuts = chunking.Slider(known, m, inline).cut(data)
        assert b"".join(data[a:b] for _, a, b in cuts) == data
        if not any(k == "ref" for k, *_ in cuts):
            assert [(a, b) for _, a, b in cuts] == [(i, min(i + m, len(data))) for i in range(0, len(data), m)]
    block = draw.randbytes(64)
    assert [k for k, *_ in chunking.Slider(set(), 64, 1).cut(block + block)] == ["new", "ref"]
    first = draw.randbytes(640)
    known = {(hashing.digest(first[i : i + 64]), hashlib.sha1(first[i : i + 64]).digest()[:16]) for i in range(0, 640, 64)}
    moved = chunking.Slider(known, 64, 1).cut(first[:100] + b"!" + first[100:])
    assert sum(k == "ref" for k, *_ in moved) >= 8


def test_fixed_pieces_of_odd_sizes(spark):
    sizes = [0, 1, 127, 128, 129, 255, 256, 257, 511, 512]
    rows = [(n, "s", str(n), bytes(range(256)) * 3) for n in sizes]
    streams = spark.createDataFrame(rows, "stream_id long, session string, path string, payload binary").withColumn("payload", F.expr("substring(payload, 1, int(stream_id))"))
    found = chunking.instructions(chunking.fixed_pieces(streams, 256)).collect()
    for n in sizes:
        own = sorted((r.seq, r.size, r.crypto is None) for r in found if r.stream_id == n)
        assert own == [(i // 256, min(256, n - i), min(256, n - i) < 128) for i in range(0, n, 256)]


def test_next_fit(spark):
    assert [b for b, _ in bundles.next_fit([60, 50, 30, 40, 90, 10], 100)] == [0, 1, 1, 2, 3, 3]
    assert bundles.next_fit([500, 1], 100) == [(0, 0), (1, 0)]
    draw = random.Random(3)
    rows = [(s, i, draw.randrange(1, 150)) for s in ("a", "b") for i in range(300)]
    got = bundles.packed(spark.createDataFrame(rows, "session string, n int, size int"), ["n"], 100).collect()
    for s in ("a", "b"):
        own = sorted((r.n, r.size, r.bundle_id, r.pos) for r in got if r.session == s)
        assert [x[2:] for x in own] == bundles.next_fit([x[1] for x in own], 100)


def test_gc_branches(spark):
    rows = [("i1", 0, 0, "u1", 1), ("i1", 1, 0, "k1", 1), ("i1", 1, 1, "u2", 1), ("i1", 2, 0, "k2", 1), ("i2", 0, 0, "k2", 1), ("i2", 1, 0, "k3", 1)]
    idx = spark.createDataFrame(rows, "session string, bundle_id long, pos int, crypto string, size int")
    used = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "crypto string")
    act = lambda **k: {(r.session, r.bundle_id): r.action for r in gc.classified(idx, used, **k).collect()}
    assert act() == {("i1", 0): "remove", ("i1", 1): "modify", ("i1", 2): "keep", ("i2", 0): "keep", ("i2", 1): "keep"}
    assert act(deep=True) == {**act(), ("i2", 0): "remove"}
    assert set(act(repack=True).values()) == {"remove", "modify"}
    after = gc.rewritten(idx, used, 10)
    assert {r.crypto for r in after.collect()} == {"k1", "k2", "k3"}
    again = gc.rewritten(after.drop("moved"), used, 10)
    assert sorted(again.drop("moved").collect()) == sorted(after.drop("moved").collect())


def test_exchange(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "path string") for s in ("pq", "qr"))
    assert [r.path for r in exchange.missing(a, b).collect()] == ["p"]
    both = exchange.exchanged(a, b)
    assert sorted(r.path for r in both.collect()) == ["p", "q", "r"] and exchange.missing(a, both).isEmpty()


def test_rules(spark):
    names = ["r", "r/a", "r/a/.no-backup", "r/a/b", "r/a/b/.backup", "r/a/b/f", "r/.no-backup-c", "r/c", "r/d", "r/d/.no-backup", "r/d/.backup", "r/a/.backup-e", "r/a/e", "r/a/x", "r/.no-backup-gone"]
    folders = {"r", "r/a", "r/a/b", "r/c", "r/d"}
    tree = spark.createDataFrame([(p, p.rpartition("/")[0] or None, p.rpartition("/")[2], p in folders, False) for p in names], "path string, parent string, name string, is_dir boolean, is_symlink boolean")
    got = {r.path: r.included for r in rules.decided(tree).collect()}
    assert {p for p, x in got.items() if not x} == {"r/a", "r/a/.no-backup", "r/c", "r/a/.backup-e", "r/a/x"}
    assert [r.name for r in rules.unmatched(tree).collect()] == [".no-backup-gone"]


def test_codecs_and_keys(spark):
    data = random.Random(4).randbytes(1000) * 3
    df = spark.createDataFrame([(data,)], "b binary")
    for method in ("lzma", "zlib", "zero"):
        packed = df.select(codecs.compress(F.col("b"), method).alias("b"), F.lit(method).alias("m"))
        assert packed.select(codecs.decompress(F.col("b"), F.col("m"))).first()[0] == data
    info = codecs.wrap(spark, b"k" * 16, "blah")
    assert codecs.unwrap(spark, info, "blah") == b"k" * 16
    with pytest.raises(ValueError):
        codecs.unwrap(spark, info, "bla")
    assert codecs.unwrap(spark, codecs.new_password(spark, info, "blah", "new"), "new") == b"k" * 16


@pytest.mark.parametrize("password", [None, "blah"])
def test_repository(spark, tmp_path, password):
    draw = random.Random(5)
    block = draw.randbytes(700)
    rows = [(1, "a/1", block), (2, "a/2", block + b"tail"), (3, "a/3", b""), (4, "b/4", draw.randbytes(5000))]
    streams = spark.createDataFrame(rows, "stream_id long, path string, payload binary")
    repo = Repository.init(spark, str(tmp_path / "r"), Config(256, 1024, "zlib"), password)
    with pytest.raises(FileExistsError):
        Repository.init(spark, str(tmp_path / "r"))
    repo.backup(streams.where("stream_id < 4"), "s1", password)
    repo.backup(streams.where("stream_id = 4"), "s2", password)
    with pytest.raises(FileExistsError):
        repo.backup(streams.where("stream_id = 1"), "s3", password)
    assert {r.stream_id: bytes(r.payload) for r in repo.restore(password).collect()} == {i: b for i, _, b in rows}
    n_before = repo.table("index").count()
    asked = spark.createDataFrame([(4, 250, 600), (1, 0, 0), (2, 690, 14)], "stream_id long, start long, length long")
    assert {r.stream_id: bytes(r.bytes) for r in repo.read(asked, password).collect()} == {4: rows[3][2][250:850], 1: b"", 2: (block + b"tail")[690:704]}
    with pytest.raises(Exception, match="out of range"):
        repo.read(spark.createDataFrame([(1, 699, 2)], asked.schema), password).collect()
    repo.forget(spark.createDataFrame([("b/4",)], "path string"))
    repo.collect_garbage(password)
    assert 0 < repo.table("index").count() < n_before
    assert {r.stream_id: bytes(r.payload) for r in repo.restore(password).collect()} == {i: b for i, _, b in rows[:3]}
    if password:
        with pytest.raises(ValueError):
            repo.payloads("wrong")
        repo.passwd(password, "other")
        assert repo.payloads("other").count() == repo.table("index").count()
    else:
        with pytest.raises(ValueError):
            repo.passwd("a", "b")
    repo.set_option("chunk.max_size", "4kib")
    assert repo.config.chunk_max_size == 4096 and Repository.root_of("/x/backups/y/backups/z") == "/x/backups/y"


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/big").write_bytes(b"x" * 100)
    (tmp_path / "small").write_bytes(b"y")
    got = sources.file_streams(spark, str(tmp_path), 10).collect()
    assert [(r.session, bytes(r.payload)) for r in got] == [("d", b"x" * 100)]


def test_missing_chunk_is_an_error(spark):
    refs = spark.createDataFrame([("aa", 1)], "crypto string, size int")
    nothing = spark.createDataFrame([], "crypto string, session string, bundle_id long, pos int")
    with pytest.raises(Exception, match="no such chunk"):
        index.located(refs, nothing).collect()


def test_backup_slides_over_inserted_bytes(spark, tmp_path):
    data = random.Random(6).randbytes(2560)
    moved = data[:300] + b"!" + data[300:]
    repo = Repository.init(spark, str(tmp_path / "r"), Config(256, 1024, "zlib"))
    schema = "stream_id long, path string, payload binary"
    repo.backup(spark.createDataFrame([(1, "a", data)], schema), "s1")
    n = repo.table("index").count()
    repo.backup(spark.createDataFrame([(2, "b", moved)], schema), "s2")
    assert repo.table("index").count() - n <= 2
    assert {r.stream_id: bytes(r.payload) for r in repo.restore().collect()} == {1: data, 2: moved}
    # and after a collection
    repo.collect_garbage(repack=True)
    n = repo.table("index").count()
    repo.backup(spark.createDataFrame([(3, "c", b"??" + data)], schema), "s3")
    assert repo.table("index").count() == n
    assert {r.stream_id: bytes(r.payload) for r in repo.restore().collect()} == {1: data, 2: moved, 3: b"??" + data}


STREAMS = "stream_id long, path string, payload binary"


def contents(repo, password=None):
    return {r.path: bytes(r.payload) for r in repo.restore(password).join(repo.table("backups").select("stream_id", "path"), "stream_id").collect()}


def test_requests_that_repeat_are_each_answered(spark, tmp_path):
    data = random.Random(9).randbytes(900)
    repo = Repository.init(spark, str(tmp_path / "r"), Config(256, 1024, "zlib"))
    repo.backup(spark.createDataFrame([(1, "a", data)], STREAMS), "s")
    asked = spark.createDataFrame([(1, 200, 300)] * 3 + [(1, 0, 10), (1, 900, 0)], "stream_id long, start long, length long")
    assert sorted((r.start, bytes(r.bytes)) for r in repo.read(asked).collect()) == [(0, data[:10])] + [(200, data[200:500])] * 3 + [(900, b"")]


def test_checks_hold_whatever_columns_are_asked_for(spark, tmp_path):
    data = random.Random(10).randbytes(900)
    repo = Repository.init(spark, str(tmp_path / "r"), Config(256, 1024, "zlib"))
    repo.backup(spark.createDataFrame([(1, "a", data), (2, "b", data[:400])], STREAMS), "s")
    manifests = repo.table("backups").withColumn("sha256", F.when(F.col("stream_id") == 2, "00").otherwise(F.col("sha256")))
    whole = restore.restored(repo.table("instructions"), repo.payloads(), manifests)
    for rows in (restore.verified(whole, manifests).select("stream_id", "size"), restore.verified(whole, manifests).select("stream_id")):
        with pytest.raises(Exception, match="checksum mismatch"):
            rows.collect()
    lost = repo.payloads().limit(1)
    with pytest.raises(Exception, match="no such chunk"):
        restore.emitted(repo.table("instructions"), lost).select("stream_id", "seq").collect()
    refs = spark.createDataFrame([("aa", 1)], "crypto string, size int")
    with pytest.raises(Exception, match="no such chunk"):
        index.located(refs, repo.table("index")).select("size").collect()


def test_sessions_of_one_name_and_streams_of_one_id(spark, tmp_path):
    draw = random.Random(11)
    a, b = draw.randbytes(3000), draw.randbytes(3000)
    repo = Repository.init(spark, str(tmp_path / "r"), Config(256, 1024, "zlib"))
    repo.backup(spark.createDataFrame([(1, "a", a)], STREAMS), "same")
    repo.backup(spark.createDataFrame([(2, "b", b)], STREAMS), "same")
    places = repo.table("index").groupBy("session", "bundle_id", "pos").count()
    assert places.where("count > 1").isEmpty() and contents(repo) == {"a": a, "b": b}
    for rows in ([(1, "c", b"x")], [(3, "c", b"x"), (3, "d", b"y")], [(3, "c", b"x"), (4, "c", b"y")]):
        with pytest.raises(FileExistsError):
            repo.backup(spark.createDataFrame(rows, STREAMS), "t")


def test_a_session_that_broke_off_leaves_nothing_to_restore(spark, tmp_path, monkeypatch):
    data = random.Random(12).randbytes(2000)
    repo = Repository.init(spark, str(tmp_path / "r"), Config(256, 1024, "zlib"))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr("chunkmill.plans.repository.restore.inspect_fast", broken)
        with pytest.raises(RuntimeError):
            repo.backup(spark.createDataFrame([(1, "a", data)], STREAMS), "s")
    assert repo.table("instructions").isEmpty() and repo.table("backups").isEmpty() and not repo.table("index").isEmpty()
    n = repo.table("index").count()
    repo.backup(spark.createDataFrame([(1, "a", data)], STREAMS), "s")
    assert contents(repo) == {"a": data} and repo.table("index").count() == n  # its chunks are referred to


def test_collection_carries_kept_bundles_over(spark, tmp_path):
    draw = random.Random(13)
    kept, gone = draw.randbytes(4096), draw.randbytes(2048)
    repo = Repository.init(spark, str(tmp_path / "r"), Config(256, 1024, "zlib"), "pw")
    repo.backup(spark.createDataFrame([(1, "a", kept)], STREAMS), "s", "pw")
    repo.backup(spark.createDataFrame([(2, "b", gone), (3, "c", gone[:256])], STREAMS), "s", "pw")
    before = {(r.session, r.bundle_id): bytes(r.payload) for r in repo.table("bundles").collect()}
    repo.forget(spark.createDataFrame([("b",)], "path string"))
    repo.collect_garbage("pw", concat=True)
    after = {(r.session, r.bundle_id): bytes(r.payload) for r in repo.table("bundles").collect()}
    # the initialization vectors are random: equal bytes have not been encrypted again
    assert len(before.items() & after.items()) == 4 and len(after) == 5
    assert len(repo.table("index").inputFiles()) == 1
    assert contents(repo, "pw") == {"a": kept, "c": gone[:256]}


@pytest.mark.parametrize("keys", [(None, None), ("one", None), ("one", "two")])
def test_export_and_import_transfer(spark, tmp_path, keys):
    draw = random.Random(14)
    shared, a, b = draw.randbytes(1024), draw.randbytes(3000), draw.randbytes(900)
    first = Repository.init(spark, str(tmp_path / "x"), Config(256, 1024, "lzma", 1), keys[0])
    second = Repository.init(spark, str(tmp_path / "y"), Config(256, 2048, "zlib"), keys[1])
    first.backup(spark.createDataFrame([(1, "a", shared + a), (2, "b", b)], STREAMS), "s", keys[0])
    second.backup(spark.createDataFrame([(3, "b", b"another"), (4, "d", shared)], STREAMS), "t", keys[1])
    assert [r.path for r in first.missing_in(second).collect()] == ["a"]
    assert [r.path for r in first.export_to(second, *keys).collect()] == ["a"]
    assert contents(second, keys[1]) == {"a": shared + a, "b": b"another", "d": shared}
    assert first.export_to(second, *keys).isEmpty()
    assert [r.path for r in first.import_from(second, *keys).collect()] == ["d"]
    assert contents(first, keys[0]) == {"a": shared + a, "b": b, "d": shared}
    second.collect_garbage(keys[1])
    assert contents(second, keys[1]) == {"a": shared + a, "b": b"another", "d": shared}


def test_versions_and_options(spark, tmp_path):
    repo = Repository.init(spark, str(tmp_path / "r"), Config(256, 1024, "zlib"))
    repo.set_option("chunk.max_size", "4KiB")
    assert repo.config.shown()["chunk.max_size"] == "4096"
    repo.set_option("chunk.max_size", None)
    assert repo.config.chunk_max_size == Config().chunk_max_size and repo.config.compression_method == "zlib"
    with pytest.raises(ValueError):
        repo.set_option("chunk.min_size", None)
    assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("config")]) == 1
    repo._save("config", {"version": 99})
    with pytest.raises(ValueError, match="version 99"):
        repo.restore()
    # a bundle of the first version names no compression
    old = spark.createDataFrame([("s", 0, None, [("aa", 3)], codecs.codec("lzma")[0](b"abc"))], "session string, bundle_id long, method string, records array<struct<crypto: string, size: int>>, payload binary")
    assert bytes(bundles.unpacked(old).first().bytes) == b"abc"
    with pytest.raises(Exception, match="does not hold"):
        bundles.unpacked(old.withColumn("records", F.expr("array(named_struct('crypto', 'aa', 'size', 4))"))).collect()


def test_files_that_vanish(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_bytes(name.encode())
    strict, tolerant = (sources.file_streams(spark, str(tmp_path), tolerant=t) for t in (False, True))
    assert sorted(r.relative for r in strict.collect()) == ["one", "two"]
    (tmp_path / "two").unlink()
    assert [r.relative for r in tolerant.collect()] == ["one"]
    with pytest.raises(Exception, match="(?i)exist"):
        strict.collect()
