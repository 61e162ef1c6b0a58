"""A repository: tables in one folder, and the commands on it.

    root/config.N, root/key.N       one-row JSON files; the greatest N counts
    root/backups/listing=N          stream_id, path, size, sha256, iterations, session
    root/instructions/listing=N     stream_id, session, seq, offset, size, crypto, inline
    root/index/snapshot=N           session, bundle_id, pos, crypto, size, digest
    root/bundles/snapshot=N         session, bundle_id, method, records, payload

A session is stored under a name that is never used again: bundles, then the index, then instructions, and its rows of
`backups` last. These commit it: instructions of a session without them are not read, and what a broken session left
of chunks is good to refer to or goes with the next collection. A collection writes the next snapshot, forgetting the
next listing; the config then names it, and the old one is deleted.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.hashing import parse_size, rolling_hex, signed
from ..operators import bundles as packing
from ..operators import chunking, exchange, gc, index, restore


#: Of the format; a repository of a later one is not opened.
VERSION = 1
#: Options by name, and the fields that hold them.
OPTIONS = {"chunk.max_size": "chunk_max_size", "bundle.max_payload_size": "bundle_max_payload_size", "bundle.compression_method": "compression_method", "lzma.compression_level": "lzma_level"}


@dataclass(frozen=True)
class Config:
    """Storable options, with their defaults."""

    chunk_max_size: int = 65_536
    bundle_max_payload_size: int = 2 << 20
    compression_method: str = "lzma"
    lzma_level: int = 6
    snapshot: int = 0
    listing: int = 0
    version: int = VERSION

    def changed(self, option: str, value: str | None) -> Config:
        """One option from its text, e.g. chunk.max_size = 64KiB; None is its default."""
        option = {"compression": "bundle.compression_method"}.get(option, option)
        if option not in OPTIONS:
            raise ValueError(f"no such option: {option}")
        name = OPTIONS[option]
        if value is None:
            return replace(self, **{name: getattr(Config(), name)})
        if option.endswith("_size"):
            return replace(self, **{name: parse_size(value)})
        if option == "bundle.compression_method":
            codecs.codec(value)
            return replace(self, compression_method=value)
        if not 0 <= int(value) <= 19:
            raise ValueError("levels are from 0 to 19")
        return replace(self, lzma_level=int(value))

    def shown(self) -> dict[str, str]:
        """Every option's text."""
        return {option: str(getattr(self, name)) for option, name in OPTIONS.items()}


SCHEMAS = {
    "index": "session string, bundle_id long, pos int, crypto string, size int, digest long",
    "bundles": "session string, bundle_id long, method string, records array<struct<crypto: string, size: int>>, payload binary",
    "backups": "stream_id long, path string, size long, sha256 string, iterations int, session string",
    "instructions": "stream_id long, session string, seq int, offset long, size int, crypto string, inline binary",
}


class Repository:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files of one row, through Spark's own file systems
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        if not self._fs().exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(self._path(""))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{name}\.(\d+)", n)))

    def _save(self, name: str, value: dict) -> None:
        """The next version appears at once, by a rename; the ones before go afterwards."""
        old = self._versions(name)
        new = (old[-1] if old else 0) + 1
        at = f"{name}.new-{uuid.uuid4().hex}"
        out = self._fs().create(self._path(at), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self._fs().rename(self._path(at), self._path(f"{name}.{new}")):
            raise FileExistsError(f"{name} was changed meanwhile")
        for n in old:
            self._fs().delete(self._path(f"{name}.{n}"), False)

    def _load(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/{name}.{self._versions(name)[-1]}", wholetext=True).first()[0])

    def _has(self, name: str) -> bool:
        return bool(self._versions(name))

    @classmethod
    def init(cls, spark: SparkSession, root: str, config: Config = Config(), password: str | None = None) -> Repository:
        """Creates the folder; an existing repository is an error."""
        import os

        repo = cls(spark, root)
        if repo._has("config"):
            raise FileExistsError(root)
        if password is not None:
            repo._save("key", {k: v.hex() if isinstance(v, bytes) else v for k, v in asdict(codecs.wrap(spark, os.urandom(16), password)).items()})
        repo._save("config", asdict(config))
        return repo

    @staticmethod
    def root_of(backup: str) -> str:
        """The repository of a backup's path: what stands before its last /backups/."""
        m = re.fullmatch(r"(.*)/backups/.*", backup)
        if not m:
            raise ValueError(f"not below a folder of backups: {backup}")
        return m[1]

    @property
    def config(self) -> Config:
        found = Config(**self._load("config"))
        if found.version > VERSION:
            raise ValueError(f"the repository is of version {found.version}, known are those up to {VERSION}")
        return found

    def set_option(self, option: str, value: str | None) -> None:
        """Sets an option, or with None puts it back to its default."""
        self._save("config", asdict(self.config.changed(option, value)))

    def _key_info(self) -> codecs.KeyInfo:
        return codecs.KeyInfo(**{k: bytes.fromhex(v) if isinstance(v, str) else v for k, v in self._load("key").items()})

    def _key(self, password: str | None) -> bytes | None:
        if self._has("key") != (password is not None):
            raise ValueError("a password is given for an encrypted repository, and only for one")
        return codecs.unwrap(self.spark, self._key_info(), password) if password is not None else None

    def passwd(self, old: str, new: str) -> None:
        """Wraps the same data key by another password; a repository without encryption has none to change."""
        if not self._has("key"):
            raise ValueError("the repository is not encrypted")
        self._save("key", {k: v.hex() if isinstance(v, bytes) else v for k, v in asdict(codecs.new_password(self.spark, self._key_info(), old, new)).items()})

    def _at(self, name: str, config: Config) -> str:
        return f"{self.root}/{name}/" + (f"snapshot={config.snapshot}" if name in ("index", "bundles") else f"listing={config.listing}")

    def table(self, name: str) -> DataFrame:
        """Rows of a table; instructions are those of committed sessions."""
        at = self._at(name, self.config)
        found = self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(at))
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(at) if found else self.spark.createDataFrame([], SCHEMAS[name])
        if name == "instructions":
            rows = rows.join(self.table("backups").select("session").distinct(), "session", "left_semi").select(rows.columns)
        return rows

    def _bundles(self, wanted: DataFrame | None = None) -> DataFrame:
        """Stored bundles; of wanted chunks (crypto) only those that hold one. A wanted chunk that is nowhere is an error."""
        bundles = self.table("bundles")
        if wanted is None:
            return bundles
        places = index.located(wanted.select("crypto").distinct(), self.table("index"))
        places = places.select(F.col("bundle_session").alias("session"), "bundle_id").distinct()
        return bundles.join(places, ["session", "bundle_id"], "left_semi")

    def _opened(self, bundles: DataFrame, key: bytes | None) -> DataFrame:
        return bundles if key is None else bundles.withColumn("payload", codecs.decrypt(F.col("payload"), F.lit(key)))

    def _closed(self, bundles: DataFrame, key: bytes | None) -> DataFrame:
        return bundles if key is None else bundles.withColumn("payload", codecs.encrypt(F.col("payload"), F.lit(key)))

    def payloads(self, password: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """(crypto, bytes) of everything stored, or of what the bundles that hold wanted chunks (crypto) have."""
        return packing.unpacked(self._opened(self._bundles(wanted), self._key(password))).select("crypto", "bytes")

    def _append(self, packed: DataFrame, payloads: DataFrame, key: bytes | None, config: Config) -> None:
        stored = packing.stored(packed, payloads, config.compression_method, config.lzma_level)
        # bundles first, then the index that names them
        self._closed(stored, key).write.mode("append").parquet(self._at("bundles", config))
        digests = payloads.select("crypto", signed(rolling_hex("bytes")).alias("digest"))
        packed.join(digests, "crypto").select("session", "bundle_id", "pos", "crypto", "size", "digest").write.mode("append").parquet(self._at("index", config))

    def _delete(self, path: str) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def backup(self, streams: DataFrame, session: str, password: str | None = None) -> None:
        """Stores streams (stream_id, path, payload) as one session; a path or stream_id that exists is an error.

        Streams are cut by sliding against the index as it was before the session and against themselves.
        """
        c, key = self.config, self._key(password)
        named = f"{session}-{uuid.uuid4().hex}"
        streams = streams.withColumn("session", F.lit(named))
        backups = self.table("backups")
        for name in ("path", "stream_id"):
            if not streams.join(backups, name, "left_semi").isEmpty() or not streams.groupBy(name).count().where("count > 1").isEmpty():
                raise FileExistsError(f"a backup of that {name} exists")
        before = self.table("index")
        # written once: what is appended below must not be cut against
        at = f"{self.root}/cut-{uuid.uuid4().hex}"
        full = before.where(F.col("size") == c.chunk_max_size).select("digest", "crypto")
        chunking.sliding_pieces(streams, full, c.chunk_max_size).write.parquet(at)
        pieces = self.spark.read.parquet(at)
        made = chunking.cut_instructions(pieces)
        fresh = index.new_chunks(made.select("crypto", "stream_id", "seq", "session", "size"), before)
        packed = packing.packed(fresh, ["stream_id", "seq"], c.bundle_max_payload_size)
        first = pieces.drop("crypto").join(fresh.select("stream_id", "seq", "crypto"), ["stream_id", "seq"])
        self._append(packed, first.select("crypto", "bytes"), key, c)
        made.select(*[f.split()[0] for f in SCHEMAS["instructions"].split(", ")]).write.mode("append").parquet(self._at("instructions", c))
        manifests = restore.inspect_fast(streams).join(streams.select("stream_id", "path", "session"), "stream_id")
        manifests.select("stream_id", "path", "size", "sha256", "iterations", "session").write.mode("append").parquet(self._at("backups", c))
        self._delete(at)

    def restore(self, password: str | None = None) -> DataFrame:
        """Every stream, checked against its manifest."""
        backups = self.table("backups")
        return restore.verified(restore.restored(self.table("instructions"), self.payloads(password), backups), backups)

    def read(self, requests: DataFrame, password: str | None = None) -> DataFrame:
        """Ranges of streams; only bundles that hold a chunk of them are opened."""
        instructions = self.table("instructions")
        met = restore.met_by(instructions, restore.asked_for(instructions, requests)).where("crypto is not null")
        return restore.ranges(instructions, self.payloads(password, met), requests)

    def collect_garbage(self, password: str | None = None, deep: bool = False, repack: bool = False, concat: bool = False) -> None:
        """Keeps what the instructions use; the new snapshot is complete before the config names it.

        Kept bundles are carried over as they are; only chunks of modified ones are unpacked and packed anew.
        concat: the index becomes one file.
        """
        if repack and concat:
            raise ValueError("repack and concat exclude each other")
        c, key = self.config, self._key(password)
        new = replace(c, snapshot=c.snapshot + 1)
        used = self.table("instructions").where("crypto is not null").select("crypto").distinct()
        before = self.table("index")
        at = f"{self.root}/after-{uuid.uuid4().hex}"
        gc.rewritten(before, used, c.bundle_max_payload_size, deep, repack).write.parquet(at)
        after = self.spark.read.parquet(at)
        for name in ("bundles", "index"):  # what a collection that broke off has left
            self._delete(self._at(name, new))
        kept, moved = after.where("not moved"), after.where("moved").drop("moved")
        self.table("bundles").join(kept.select("session", "bundle_id").distinct(), ["session", "bundle_id"], "left_semi").write.parquet(self._at("bundles", new))
        again = packing.stored(moved, self.payloads(password, moved).dropDuplicates(["crypto"]), c.compression_method, c.lzma_level)
        self._closed(again, key).write.mode("append").parquet(self._at("bundles", new))
        digests = before.groupBy("crypto").agg(F.max("digest").alias("digest"))
        rows = after.join(digests, "crypto").select("session", "bundle_id", "pos", "crypto", "size", "digest")
        (rows.coalesce(1) if concat else rows).write.parquet(self._at("index", new))
        self._save("config", asdict(new))
        for path in (at, self._at("bundles", c), self._at("index", c)):
            self._delete(path)

    def forget(self, paths: DataFrame) -> None:
        """Drops backups by path (path); their chunks go with the next collection."""
        c = self.config
        new = replace(c, listing=c.listing + 1)
        gone = self.table("backups").join(paths, "path", "left_semi").select("stream_id")
        for name in ("backups", "instructions"):
            self._delete(self._at(name, new))
            self.table(name).join(gone, "stream_id", "left_anti").write.parquet(self._at(name, new))
        self._save("config", asdict(new))
        for name in ("backups", "instructions"):
            self._delete(self._at(name, c))

    def missing_in(self, other: Repository) -> DataFrame:
        """Backups that the other repository lacks, by path."""
        return exchange.missing(self.table("backups"), other.table("backups"))

    def export_to(self, other: Repository, password: str | None = None, other_password: str | None = None) -> DataFrame:
        """Transfers the backups that the other repository lacks, by path, and returns them.

        Whole bundles travel, those that hold a chunk that the other lacks; they keep their compression and get the other
        repository's key. Chunks, instructions and manifests are written in the order of a session.
        """
        key, other_key, c = self._key(password), other._key(other_password), other.config
        at = f"{other.root}/incoming-{uuid.uuid4().hex}"
        self.missing_in(other).write.parquet(at)
        incoming = self.spark.read.schema(SCHEMAS["backups"]).parquet(at)
        if not incoming.join(other.table("backups"), "stream_id", "left_semi").isEmpty():
            raise FileExistsError("a backup of that stream_id exists")
        instructions = self.table("instructions").join(incoming.select("stream_id"), "stream_id", "left_semi")
        lacked = exchange.missing(instructions.where("crypto is not null").select("crypto").distinct(), other.table("index"), "crypto")
        bundles = self._bundles(lacked).join(other.table("bundles").select("session", "bundle_id"), ["session", "bundle_id"], "left_anti")
        places = bundles.select("session", "bundle_id").distinct()
        entries = self.table("index").join(places, ["session", "bundle_id"], "left_semi")
        staged = {"bundles": other._closed(self._opened(bundles, key), other_key), "index": entries, "instructions": instructions, "backups": incoming}
        # all is read before anything is written, as the other's tables decide what travels
        for name, rows in staged.items():
            rows.select(*[f.strip().split()[0] for f in re.split(r", (?![^<]*>)", SCHEMAS[name])]).write.parquet(f"{at}-{name}")
        for name in staged:
            self.spark.read.schema(SCHEMAS[name]).parquet(f"{at}-{name}").write.mode("append").parquet(other._at(name, c))
            self._delete(f"{at}-{name}")
        found = self.spark.createDataFrame(incoming.select("path").toArrow())
        self._delete(at)
        return found

    def import_from(self, other: Repository, password: str | None = None, other_password: str | None = None) -> DataFrame:
        """The same in the other direction."""
        return other.export_to(self, other_password, password)
