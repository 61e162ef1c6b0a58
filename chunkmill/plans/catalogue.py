"""Every operator as a query over the driver's tables, with the SQL that says the same where SQL can.

A row of `documents` is a stream, its source the session that stored it. Chunks have 256 bytes at most and bundles
16384: the documents are far smaller than the storable defaults of 64 KiB and 2 MiB.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import codecs, hashing
from ..functions.hashing import chunk_id_of
from ..operators import bundles, chunking, exchange, gc, index, restore, rules
from ..streaming import run_sessions

M, CAP = 256, 16_384
#: Bytes of a block when passages are looked for.
PASSAGE = 64
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.text_streams(read(spark, sf_dir, "documents"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_pieces(streams(spark, sf_dir), M)


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.instructions(pieces(spark, sf_dir))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).select("crypto", "stream_id", "seq", "session", "size")


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.first_wins(references(spark, sf_dir))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.packed(indexed(spark, sf_dir), ["stream_id", "seq"], CAP)


def session_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index a session, none knowing the others: chunks may stand in several."""
    best = F.min(F.struct("stream_id", "seq", "size")).alias("first")
    own = references(spark, sf_dir).where("crypto is not null").groupBy("session", "crypto").agg(best).select("session", "crypto", "first.*")
    return bundles.packed(own, ["stream_id", "seq"], CAP).select("session", "bundle_id", "pos", "crypto", "size")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = indexed(spark, sf_dir).select("crypto", "stream_id", "seq")
    return pieces(spark, sf_dir).join(first, ["stream_id", "seq"]).select("crypto", "bytes")


def unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(crypto, bytes) read back from stored bundles."""
    return bundles.unpacked(bundles.stored(packed(spark, sf_dir), payloads(spark, sf_dir), "zlib", 1)).select("crypto", "bytes")


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("stream_id"))


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gc.used_chunks(made(spark, sf_dir), retained(spark, sf_dir))


_PIECES = f"""
WITH RECURSIVE streams AS (
  SELECT doc_id AS stream_id, coalesce(source, '') AS session, coalesce(source, '') || '/' || doc_id AS path, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (
  SELECT stream_id, session, i::INTEGER AS seq, i * {M} AS "offset", least({M}, n - i * {M})::INTEGER AS size, substr(h, i * {2 * M} + 1, {2 * M}) AS hx
  FROM (SELECT *, unnest(range(0, (n + {M - 1}) // {M})) AS i FROM streams)),
made AS (SELECT *, CASE WHEN size >= 128 THEN substr(sha1(unhex(hx)), 1, 32) END AS crypto FROM pieces)"""
_INDEX = _PIECES + """,
idx AS (
  SELECT crypto, stream_id, seq, session, size FROM made WHERE crypto IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY crypto ORDER BY stream_id, seq) = 1)"""
_SESSION_INDEX = _PIECES + """,
idx AS (
  SELECT crypto, stream_id, seq, session, size FROM made WHERE crypto IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session, crypto ORDER BY stream_id, seq) = 1)"""


def _pack(name: str, rows: str, order: str) -> str:
    """Next fit as a recursion over a session's rows."""
    return f""",
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {order}) AS rn FROM {rows}),
{name} AS (
  SELECT session, rn, crypto, size, 0::BIGINT AS bundle_id, 0 AS pos, size AS fill FROM {name}_o WHERE rn = 1
  UNION ALL
  SELECT o.session, o.rn, o.crypto, o.size, CASE WHEN p.fill + o.size > {CAP} THEN p.bundle_id + 1 ELSE p.bundle_id END,
    CASE WHEN p.fill + o.size > {CAP} THEN 0 ELSE p.pos + 1 END, CASE WHEN p.fill + o.size > {CAP} THEN o.size ELSE p.fill + o.size END
  FROM {name} p JOIN {name}_o o ON o.session = p.session AND o.rn = p.rn + 1)"""


_PACKED = _INDEX + _pack("pk", "idx", "stream_id, seq")
_SESSION_PACKED = _SESSION_INDEX + _pack("pk", "idx", "stream_id, seq")
_USED = """,
used AS (SELECT DISTINCT crypto FROM made WHERE crypto IS NOT NULL AND stream_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""
_CLASSIFIED = """,
cls AS (
  SELECT session, bundle_id, total, used, CASE WHEN used = 0 AND total > 0 THEN 'remove' WHEN used < total THEN 'modify' WHEN total = 0 THEN 'remove' ELSE 'keep' END AS action
  FROM (SELECT session, bundle_id, count(*) FILTER (counts) AS total, count(*) FILTER (counts AND crypto IN (SELECT crypto FROM used)) AS used FROM {rows} GROUP BY session, bundle_id))"""
_FAST = _USED + _CLASSIFIED.format(rows="(SELECT *, true AS counts FROM pk)")
_DEEP = _USED + _CLASSIFIED.format(rows="(SELECT *, row_number() OVER (PARTITION BY crypto ORDER BY session, bundle_id, pos) = 1 AS counts FROM pk)")
_ROLLING = """list_reduce(list_prepend(1::HUGEINT, list_transform(range(1, 2 * size, 2), lambda p: ('0x' || substr(hx, p::INTEGER, 2))::UTINYINT::HUGEINT)), lambda a, x: (a * 257 + x) % 18446744073709551616::HUGEINT)"""
_ROLLING_HEX = f"lpad(lower(to_hex(({_ROLLING})::UBIGINT)), 16, '0')"


@query("SELECT doc_id AS stream_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents")
def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.inspect_fast(streams(spark, sf_dir)).select("stream_id", "size", "sha256")


@query(_PIECES + ' SELECT stream_id, session, seq, "offset", size, lower(hx) AS bytes FROM pieces')
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).withColumn("bytes", hashing.lower_hex(F.col("bytes")))


@query(_PIECES + f" SELECT stream_id, seq, {_ROLLING_HEX} AS digest FROM pieces")
def rolling_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.rolling_digests(pieces(spark, sf_dir).select("stream_id", "seq", "bytes"))


@query(_PIECES + f"""
SELECT stream_id, seq, crypto || array_to_string(list_transform([15, 13, 11, 9, 7, 5, 3, 1], lambda p: substr({_ROLLING_HEX}, p, 2)), '') AS chunk_id
FROM (SELECT stream_id, seq, crypto, size, hx FROM made WHERE crypto IS NOT NULL)""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir).where(F.col("size") >= chunking.INLINE).select("stream_id", "seq", hashing.chunk_id(F.col("bytes")).alias("chunk_id"))


@query(_INDEX + " SELECT crypto, stream_id, seq, session, size FROM idx")
def dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(spark, sf_dir)


@query(_INDEX + """
SELECT s.session, s.streams, s.logical_bytes, coalesce(i.stored_bytes, 0)::BIGINT AS stored_bytes, s.chunks, coalesce(i.new_chunks, 0)::BIGINT AS new_chunks
FROM (SELECT x.session, x.streams, x.logical_bytes, coalesce(c.chunks, 0)::BIGINT AS chunks
  FROM (SELECT session, count(*)::BIGINT AS streams, sum(n)::BIGINT AS logical_bytes FROM streams GROUP BY session) x
  LEFT JOIN (SELECT session, count(crypto)::BIGINT AS chunks FROM made GROUP BY session) c ON c.session = x.session) s
LEFT JOIN (SELECT session, sum(size)::BIGINT AS stored_bytes, count(*)::BIGINT AS new_chunks FROM idx GROUP BY session) i ON i.session = s.session""")
def dedup_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = streams(spark, sf_dir).groupBy("session").agg(F.count("*").alias("streams"), F.sum(F.octet_length("payload").cast("long")).alias("logical_bytes"))
    # one pre-aggregation by chunk serves both figures: every first holder carries its chunk's size
    refs = references(spark, sf_dir).where("crypto is not null")
    chunks = refs.groupBy("session").agg(F.count("*").alias("chunks"))
    new = index.first_wins(refs).groupBy("session").agg(F.sum("size").alias("stored_bytes"), F.count("*").alias("new_chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return whole.join(chunks, "session", "left").join(new, "session", "left").select("session", "streams", "logical_bytes", zero("stored_bytes"), zero("chunks"), zero("new_chunks"))


_PROBES = _INDEX + f""",
second AS (SELECT item_id AS stream_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
bench AS (SELECT stream_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM second),
probe AS (
  SELECT stream_id, seq, size, substr(sha1(unhex(hx)), 1, 32) AS crypto
  FROM (SELECT stream_id, i::INTEGER AS seq, least({M}, n - i * {M})::INTEGER AS size, substr(h, i * {2 * M} + 1, {2 * M}) AS hx FROM (SELECT *, unnest(range(0, (n + {M - 1}) // {M})) AS i FROM bench))
  WHERE size >= 128)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a second repository: the benchmark's items and the labelled documents."""
    labelled = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi")
    other = sources.text_streams(read(spark, sf_dir, "benchmark").select("item_id", "text").union(labelled), "item_id", "text", None)
    return chunking.instructions(chunking.fixed_pieces(other, M)).select("stream_id", "seq", "size", "crypto")


@query(_PROBES + " SELECT stream_id, seq, size, crypto FROM probe WHERE crypto IN (SELECT crypto FROM idx)")
def index_hit_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.hits(probes(spark, sf_dir), indexed(spark, sf_dir)).select("stream_id", "seq", "size", "crypto")


@query(_PROBES + " SELECT stream_id, seq, size, crypto FROM probe WHERE crypto NOT IN (SELECT crypto FROM idx)")
def index_miss_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.misses(probes(spark, sf_dir), indexed(spark, sf_dir)).select("stream_id", "seq", "size", "crypto")


@query(_INDEX + f"""
SELECT count(*)::BIGINT AS digests, sum(k)::BIGINT AS chunks, max(k)::BIGINT AS most
FROM (SELECT digest, count(DISTINCT crypto) AS k FROM (SELECT crypto, {_ROLLING_HEX} AS digest FROM (SELECT DISTINCT crypto, size, hx FROM made WHERE crypto IS NOT NULL)) GROUP BY digest)""")
def soft_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.rolling_collisions(payloads(spark, sf_dir)).agg(F.count("*").alias("digests"), F.sum("chunks").alias("chunks"), F.max("chunks").alias("most"))


@query(_PACKED + " SELECT session, bundle_id, pos, crypto, size FROM pk")
def bundle_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("session", "bundle_id", "pos", "crypto", "size")


@query(_PACKED + " SELECT session, bundle_id, count(*)::BIGINT AS chunks, sum(size)::BIGINT AS payload FROM pk GROUP BY session, bundle_id")
def bundle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.stats(packed(spark, sf_dir))


@query(_PACKED + " SELECT substr(sha1(session || '/' || bundle_id), 1, 2) AS folder, count(*)::BIGINT AS bundles FROM (SELECT DISTINCT session, bundle_id FROM pk) GROUP BY folder")
def bundle_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.spread_bundles(packed(spark, sf_dir).select("session", "bundle_id").distinct()).groupBy("folder").agg(F.count("*").alias("bundles"))


@query(_PIECES + """
SELECT stream_id, seq, size, crypto, CASE WHEN crypto IS NULL THEN lower(hx) END AS inline,
  coalesce(sum(size) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM made""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.offsets(made(spark, sf_dir)).select("stream_id", "seq", "size", "crypto", hashing.lower_hex(F.col("inline")).alias("inline"), "offset")


@query(ORACLE_SQL["stream_profile"])
def restore_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore.restored(made(spark, sf_dir), unpacked(spark, sf_dir), streams(spark, sf_dir))
    return restore.verified(found, restore.inspect_fast(streams(spark, sf_dir))).select("stream_id", "size", "sha256")


@query(_PIECES + """
SELECT stream_id, (n // 3)::BIGINT AS start, (n // 4)::BIGINT AS length, sha256(unhex(substr(h, (2 * (n // 3) + 1)::BIGINT, (2 * (n // 4))::BIGINT))) AS sha256 FROM streams""")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("payload")
    asked = streams(spark, sf_dir).select("stream_id", F.floor(n / 3).alias("start"), F.floor(n / 4).alias("length"))
    return restore.ranges(made(spark, sf_dir), unpacked(spark, sf_dir), asked).select("stream_id", "start", "length", F.sha2("bytes", 256).alias("sha256"))


_MAP = _PACKED + """,
map AS (
  SELECT m.stream_id, p.session AS bundle_session, p.bundle_id, count(*)::BIGINT AS refs, min(m."offset")::BIGINT AS first_offset, sum(m.size)::BIGINT AS bytes
  FROM made m JOIN pk p ON p.crypto = m.crypto GROUP BY m.stream_id, p.session, p.bundle_id)"""


@query(_MAP + " SELECT * FROM map")
def chunk_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.chunk_map(made(spark, sf_dir), packed(spark, sf_dir))


@query(_PIECES + _USED + " SELECT crypto FROM used")
def gc_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return used(spark, sf_dir)


@query(_PACKED + _FAST + " SELECT session, bundle_id, total, used, action FROM cls")
def gc_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gc.classified(packed(spark, sf_dir), used(spark, sf_dir))


@query(_PACKED + _FAST + """
SELECT session, sum(total)::BIGINT AS total, sum(used)::BIGINT AS used, count(*) FILTER (action = 'keep') AS kept, count(*) FILTER (action = 'modify') AS modified, count(*) FILTER (action = 'remove') AS removed,
  CASE WHEN count(*) FILTER (action <> 'keep') > 0 THEN 'rewritten' ELSE 'kept' END AS fate FROM cls GROUP BY session""")
def gc_index_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gc.index_rollup(gc.classified(packed(spark, sf_dir), used(spark, sf_dir)))


@query(_PACKED + _FAST + """,
moving AS (SELECT p.session, p.bundle_id AS old, p.pos AS old_pos, p.crypto, p.size FROM pk p JOIN cls c ON c.session = p.session AND c.bundle_id = p.bundle_id WHERE c.action = 'modify' AND p.crypto IN (SELECT crypto FROM used))"""
    + _pack("again", "moving", "old, old_pos DESC") + """
SELECT p.session, p.bundle_id, p.pos, p.crypto, p.size, false AS moved FROM pk p JOIN cls c ON c.session = p.session AND c.bundle_id = p.bundle_id WHERE c.action = 'keep'
UNION ALL SELECT a.session, a.bundle_id + l.last + 1, a.pos, a.crypto, a.size, true FROM again a JOIN (SELECT session, max(bundle_id) AS last FROM pk GROUP BY session) l ON l.session = a.session""")
def gc_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gc.rewritten(packed(spark, sf_dir).select("session", "bundle_id", "pos", "crypto", "size"), used(spark, sf_dir), CAP)


@query(_SESSION_PACKED + _DEEP + " SELECT session, bundle_id, total, used, action FROM cls")
def gc_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gc.classified(session_index(spark, sf_dir), used(spark, sf_dir), deep=True)


_PATHS = "SELECT coalesce(source, '') || '/' || doc_id AS path FROM documents"
_KEPT = "SELECT coalesce(source, '') || '/' || doc_id AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def other_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second repository: the labelled documents, and the pages."""
    labelled = streams(spark, sf_dir).join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("stream_id")), "stream_id", "left_semi").select("path")
    return labelled.union(read(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"))))


@query(f"{_PATHS} EXCEPT {_KEPT}")
def export_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.missing(streams(spark, sf_dir).select("path"), other_paths(spark, sf_dir))


@query("SELECT 'pages/' || page_id AS path FROM pages")
def import_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.missing(other_paths(spark, sf_dir), streams(spark, sf_dir).select("path"))


@query("SELECT doc_id AS stream_id, 0 AS iterations, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents")
def inspect_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.inspect_fast(streams(spark, sf_dir))


@query(_MAP + " SELECT stream_id, bundle_session, bundle_id FROM map")
def inspect_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.inspect_deep(made(spark, sf_dir), packed(spark, sf_dir))


@query("SELECT doc_id AS stream_id, octet_length(encode(text))::BIGINT AS size FROM documents WHERE octet_length(encode(text)) >= 2048")
def min_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.min_size(streams(spark, sf_dir), hashing.parse_size("2KiB")).select("stream_id", F.octet_length("payload").cast("long").alias("size"))


@query(ORACLE_SQL["stream_profile"])
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lit(bytes(range(16)))
    back = streams(spark, sf_dir).withColumn("payload", codecs.decrypt(codecs.encrypt(F.col("payload"), key), key))
    return restore.inspect_fast(back).select("stream_id", "size", "sha256")


@query(_PACKED + ", b AS (SELECT p.session, p.bundle_id, string_agg(m.hx, '' ORDER BY p.pos) AS x FROM pk p JOIN idx i ON i.crypto = p.crypto JOIN made m ON m.stream_id = i.stream_id AND m.seq = i.seq GROUP BY p.session, p.bundle_id) SELECT session, bundle_id, (length(x) // 2)::INTEGER AS size, sha256(unhex(x)) AS sha256 FROM b")
def compress_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = bundles.stored(packed(spark, sf_dir), payloads(spark, sf_dir), "lzma", 1)
    back = codecs.decompress(F.col("payload"), F.col("method"))
    return stored.withColumn("payload", back).select("session", "bundle_id", F.octet_length("payload").alias("size"), F.sha2("payload", 256).alias("sha256"))


@query(_PACKED + " SELECT session, bundle_id, pos, crypto, size, substr(sha1(unhex(m.hx)), 1, 32) = crypto AS same FROM (SELECT p.*, i.stream_id, i.seq FROM pk p JOIN idx i ON i.crypto = p.crypto) q JOIN (SELECT stream_id, seq, hx FROM pieces) m ON m.stream_id = q.stream_id AND m.seq = q.seq")
def bundle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bundles.unpacked(bundles.stored(packed(spark, sf_dir), payloads(spark, sf_dir), "zlib"))
    return found.select("session", "bundle_id", "pos", "crypto", "size", (hashing.crypto(F.col("bytes")) == F.col("crypto")).alias("same"))


_BYTE = "('0x' || substr(hx, (2 * j + 1)::INTEGER, 2))::UTINYINT::HUGEINT"


@query(_PIECES + f"""
SELECT s.stream_id, ((s.n + coalesce(sum((s.n - p."offset") * p.total - p.placed), 0)) % 65521 * 65536 + (1 + coalesce(sum(p.total), 0)) % 65521)::BIGINT AS adler32
FROM streams s LEFT JOIN (
  SELECT stream_id, "offset", list_sum(list_transform(range(0, size), lambda j: {_BYTE}))::HUGEINT AS total, list_sum(list_transform(range(0, size), lambda j: j * {_BYTE}))::HUGEINT AS placed FROM pieces) p
  ON p.stream_id = s.stream_id GROUP BY s.stream_id, s.n""")
def adler32_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir).select("stream_id", hashing.adler32("payload").alias("adler32"))


@query()
def sliding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages, and blocks of documents of smaller ids, found at any offset inside documents.

    The index holds blocks of PASSAGE bytes, or as long as the shortest item, so every item has one: an item's from
    every offset, so that quotes from its middle are found, and a document's fixed blocks.
    """
    other = sources.text_streams(read(spark, sf_dir, "benchmark"), "item_id", "text", None)
    shortest = other.where(F.octet_length("payload") > 0).agg(F.min(F.octet_length("payload"))).first()[0]
    size = min(PASSAGE, shortest or PASSAGE)
    own = streams(spark, sf_dir)
    # item blocks are there before all documents, a document's from its first holder on
    stored = chunking.blocks(other, size, 1).withColumn("holder", F.lit(-(2**63))).union(chunking.blocks(own, size, size).withColumn("holder", F.col("stream_id")))
    stored = stored.groupBy("digest", "crypto").agg(F.min("holder").alias("holder"))
    return chunking.sliding_pieces(own, stored, size, max(1, size // 2)).drop("bytes")


@query()
def iterated_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialized manifests of streams, cut again until they get no smaller: rounds, the last manifest and its size, and
    the chunks that the rounds store. restore.expanded() has the first manifest back from these."""
    chunk = F.col("size") >= chunking.INLINE
    line = F.struct("seq", chunk.alias("chunk"), F.when(chunk, F.unhex(hashing.chunk_id(F.col("bytes")))).otherwise(F.col("bytes")).alias("value"))
    lines = pieces(spark, sf_dir).groupBy("stream_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))

    def shrink(batches):
        for batch in batches:
            out = []
            for stream, own in zip(batch.column("stream_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                first = [(1 if x["chunk"] else 2, x["value"]) for x in own]
                # the index that rounds are cut against: the stream's own chunks, and those of the rounds before
                slider = chunking.Slider({(int.from_bytes(v[16:], "little"), v[:16]) for k, v in first if k == 1}, M, chunking.INLINE)

                def cut(b: bytes):
                    found = slider.cut(b)
                    new = {chunk_id_of(b[a:z]): b[a:z] for kind, a, z in found if kind == "new"}
                    return new, restore.serialized((2, b[a:z]) if kind == "inline" else (1, chunk_id_of(b[a:z])) for kind, a, z in found)

                rounds, last = restore.iterated(None, restore.serialized(first), cut)
                out.append((stream, len(rounds), len(last), last, [{"id": i, "bytes": x} for new in rounds for i, x in new.items()]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.struct([("id", pa.binary()), ("bytes", pa.binary())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["stream_id", "iterations", "final_size", "manifest", "chunks"])

    return lines.mapInArrow(shrink, "stream_id long, iterations int, final_size long, manifest binary, chunks array<struct<id: binary, bytes: binary>>")


@query(_INDEX + " SELECT session, count(*)::BIGINT AS chunks, sum(size)::BIGINT AS bytes FROM idx GROUP BY session")
def incremental_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of micro-batches; the index that results is the batch's."""
    root = f"{sources.shared_dir(spark)}/sessions-{spark._jvm.java.util.UUID.randomUUID()}"
    source = spark.readStream.schema(read(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    run_sessions(sources.text_streams(source), root, M, CAP, slide=False).awaitTermination()  # fixed blocks, as in the SQL
    return spark.read.parquet(f"{root}/index").groupBy("session").agg(F.count("*").alias("chunks"), F.sum(F.col("size").cast("long")).alias("bytes"))


_TREE = ["r", "r/a", "r/a/.no-backup", "r/a/b", "r/a/b/.backup", "r/a/b/f", "r/.no-backup-c", "r/c", "r/d", "r/d/.no-backup", "r/d/.backup", "r/a/.backup-e", "r/a/e", "r/a/x"]
_FOLDERS = {"r", "r/a", "r/a/b", "r/c", "r/d"}
_ENTRIES = [(p, p.rpartition("/")[0] or None, p.rpartition("/")[2], p in _FOLDERS, False) for p in _TREE]


@query(f"""
WITH RECURSIVE t(path, parent, name, is_dir) AS (VALUES {", ".join(f"('{p}', {f"'{up}'" if up else "NULL"}, '{name}', {d})" for p, up, name, d, _ in _ENTRIES)}),
m AS (
  SELECT *, is_dir AND EXISTS (FROM t x WHERE x.parent = t.path AND x.name = '.backup' AND NOT x.is_dir) AS yes, is_dir AND EXISTS (FROM t x WHERE x.parent = t.path AND x.name = '.no-backup') AS no,
    EXISTS (FROM t x WHERE x.parent = t.parent AND x.name = '.backup-' || t.name AND NOT x.is_dir) AS named_yes, EXISTS (FROM t x WHERE x.parent = t.parent AND x.name = '.no-backup-' || t.name AND NOT x.is_dir) AS named_no
  FROM t),
walk AS (
  SELECT path, is_dir, true AS above, CASE WHEN yes THEN true WHEN no THEN false ELSE true END AS included FROM m WHERE parent IS NULL
  UNION ALL
  SELECT m.path, m.is_dir, w.included, CASE WHEN m.yes THEN true WHEN m.no THEN false WHEN w.included AND m.named_no THEN false WHEN NOT w.included AND m.named_yes THEN true ELSE w.included END
  FROM walk w JOIN m ON m.parent = w.path WHERE w.is_dir)
SELECT path, included, included <> above AS flips FROM walk""")
def include_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixture tree with every kind of marker."""
    return rules.decided(spark.createDataFrame(_ENTRIES, "path string, parent string, name string, is_dir boolean, is_symlink boolean"))
