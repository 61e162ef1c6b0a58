"""MinHash near-dedup by SetSketch registers.

A document is the set of its distinct 5-word shingles. Every register holds the truncated, exponentially spaced
minimum over the set, so registers of parts merge by their maximum. Bands of registers give candidates, the
joint likelihood of two documents' registers discards those far below the threshold, and full sets confirm the rest.
Equal sets are joined before, by a hash of the whole set, and count as one member: links are those of sets, whatever
the doc_ids of their rows, and each row has those of its own text.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a row without doc_id is
kept and its component_id is null; rows that repeat a doc_id are each linked by their own text; texts of any length are
looked at whole; ties cannot be, as a component's name is its smallest doc_id; an empty table gives none; extra columns
are passed over, whatever their names. keep_one() goes by rows: of a component one stays, doc_ids null or repeated or not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linkage
from .common import WordHashes, jaccard_at_least, map_text, mix, scratch, texts, word_shingles

#: SetSketch: registers, base, rate and highest value.
REGISTERS, BASE, RATE, LIMIT = 252, 1.001, 20.0, 65535
#: A pair at the threshold is missed by all bands with at most this probability.
MISS = 1e-5
#: Standard errors of the joint estimate that a pair may lie below the threshold and still be confirmed on full sets.
MARGIN = 5.0
#: How far below the least estimate the share of equal registers may lie for an estimate to be made.
COARSE = 0.15
#: Shingles that a task remembers.
HELD = 4_000_000


_DRAWN = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
TIMES, SALT = _DRAWN[:REGISTERS] | np.uint32(1), _DRAWN[REGISTERS:]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest of 2^32 equally likely values that any shingle has in each register."""
    out = np.full(REGISTERS, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        h = x[i : i + 512, None] ^ SALT
        h *= TIMES
        np.minimum(out, h.min(0), out=out)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Uniform minima to exponential ones, then to truncated registers."""
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, LIMIT).astype(np.uint16)


def layout(per_cent: int) -> tuple[int, int]:
    """Bands and rows: the most selective whose misses at the threshold stay under MISS."""
    j = per_cent / 100
    for rows in range(16, 1, -1):
        if (1 - j**rows) ** (REGISTERS // rows) <= MISS:
            return REGISTERS // rows, rows
    return REGISTERS, 1


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_keys(regs: np.ndarray, per_cent: int) -> np.ndarray:
    """One 64-bit key a document and band."""
    bands, rows = layout(per_cent)
    x = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(48), x.shape[:2])
    for i in range(rows):
        keys = mix(keys + x[:, :, i] + np.uint64(1))
    return keys


def estimate(greater: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers are greater and less, sizes being known."""
    total = n_a + n_b
    u, v = n_a / total, n_b / total
    same = REGISTERS - greater - less

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(np.maximum(u - v * j, 1e-12)), p(np.maximum(v - u * j, 1e-12))
        return greater * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(np.shape(total)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) < likelihood(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2


def _floor(per_cent: int) -> float:
    j = per_cent / 100
    return j - MARGIN * math.sqrt(j * (1 - j) / REGISTERS)


def signatures(documents: DataFrame) -> DataFrame:
    """(id, th, n_shingles, lo, hi, regs): text hash, set size, 128-bit hash of the set and registers of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [word_shingles(t, known) for t in texts(batch)]
            regs = registers(np.stack([minima(s) for s in sets])) if sets else []
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "th", "n_shingles", "lo", "hi", "regs"])

    return map_text(documents.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text"), rows, "id long, th long, n_shingles long, lo long, hi long, regs binary")


class Documents(linkage.Comparison):
    """Documents are linked by the exact similarity of their shingle sets, if the joint estimate does not speak against it."""

    columns = ("text", "regs", "size")

    def __init__(self, per_cent: int):
        self.per_cent, self.floor, self.known = per_cent, _floor(per_cent), WordHashes()
        self.least = self.floor - COARSE
        self.sets: dict[int, np.ndarray] = {}
        self.held = 0

    def registers(self, members: list[linkage.Member]) -> np.ndarray:
        return np.frombuffer(b"".join(m[2] for m in members), np.uint16).reshape(-1, REGISTERS)

    def likely(self, a: list[linkage.Member], b: list[linkage.Member]) -> list[float | None]:
        x, y = self.registers(a), self.registers(b)
        n, m = (np.array([r[3] for r in side], float) for side in (a, b))
        at = np.flatnonzero(((x == y).sum(1) >= self.least * REGISTERS) & (100 * np.minimum(n, m) >= self.per_cent * np.maximum(n, m)))
        found = np.full(len(a), np.nan)
        found[at] = estimate((x[at] > y[at]).sum(1), (x[at] < y[at]).sum(1), n[at], m[at])
        return [float(f) if f >= self.floor else None for f in found]

    def _set(self, member: linkage.Member) -> np.ndarray:
        found = self.sets.get(member[0])
        if found is None:
            if self.held > HELD:
                self.sets, self.held = {}, 0
            found = self.sets[member[0]] = word_shingles(member[1] or "", self.known)
            self.held += len(found)
        return found

    def same(self, a: linkage.Member, b: linkage.Member) -> bool:
        return jaccard_at_least(self._set(a), self._set(b), self.per_cent)


def _components(documents: DataFrame, per_cent: int) -> DataFrame:
    """(id, th, n_shingles, component) of each row; component: the member that its links lead to, null without shingles.

    A member is a distinct set, named by the first half of its hash.
    """
    signed = scratch(signatures(documents), "signed")
    # a row of each set has its text and registers, one with a doc_id if there is any: equal sets meet before they travel
    row = F.struct(F.col("id").isNull().alias("none"), "id", "th", "n_shingles", "regs")
    one_each = signed.where("n_shingles > 0").groupBy("lo", "hi").agg(F.min(row).alias("row"))
    one_each = scratch(one_each.select(F.col("lo").alias("id"), F.col("row.id").alias("doc_id"), "row.th", F.col("row.n_shingles").alias("size"), "row.regs").dropDuplicates(["id"]), "classes")
    parts = linkage.parts_for(signed.count() * layout(per_cent)[0])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(unpacked(batch.column("regs")), per_cent)
                yield keys.ravel(), np.repeat(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), keys.shape[1])

    sets, links = linkage.grouped(map_text(one_each.select("id", "regs"), lambda batches: linkage.pack(entries(batches), parts), linkage.PACKED), parts)
    chosen = scratch(one_each.join(linkage.members(sets, links), "id", "left_semi"), "chosen")
    text_of = documents.select("doc_id", F.xxhash64("text").alias("th"), "text").alias("d")
    # hashing the short side leaves the texts unsorted
    payload = text_of.join(chosen.alias("c").hint("shuffle_hash"), F.expr("d.doc_id <=> c.doc_id and d.th = c.th"))
    payload = scratch(payload.selectExpr("c.id", "d.text", "c.regs", "c.size").dropDuplicates(["id"]), "candidates")
    joined = linkage.connected(sets, links, payload, Documents(per_cent))
    found = signed.where("n_shingles > 0").select("id", "th", "n_shingles", "lo").join(joined.select(F.col("id").alias("lo"), "component"), "lo", "left")
    # rows without shingles, however many, take no part in a join
    return found.select("id", "th", "n_shingles", F.coalesce("component", "lo").alias("component")).union(signed.where("n_shingles = 0").select("id", "th", "n_shingles", F.lit(None).cast("long")))


def near_duplicates(documents: DataFrame, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept, for each row of documents."""
    found = scratch(_components(documents, per_cent), "components")
    least = scratch(found.where("component is not null and id is not null").groupBy("component").agg(F.min("id").alias("least")), "least")
    linked = found.where("component is not null").join(least, "component", "left").select("id", "n_shingles", "least")
    found = linked.union(found.where("component is null").select("id", "n_shingles", F.lit(None).cast("long")))
    component = F.expr("if(id is null, null, coalesce(least, id))")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, per_cent: int = 80) -> DataFrame:
    """The documents without those that another row of their component stands for: the one of smallest doc_id (none comes last), then text hash."""
    found = scratch(_components(documents, per_cent).where("component is not null"), "components")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    each = scratch(found.groupBy("component", "id", "th").agg(F.count("*").alias("rows")), "rows")
    first = scratch(each.groupBy("component").agg(F.min(row).alias("first")), "first")
    # few rows: what goes, and what stays once
    judged = each.join(first, "component").withColumn("goes", ~(row == F.col("first"))).where("goes or rows > 1")
    judged = scratch(judged.select(F.col("id").alias("i"), F.col("th").alias("h"), "goes"), "judged")
    # the row is one column, so no name of its columns can clash
    names = documents.columns
    marked = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select("row", F.col("row.doc_id").alias("doc"), F.xxhash64("row.text").alias("th"))
    same = F.expr("doc <=> i and th = h")
    stay = marked.join(judged, same, "left_anti").select("row.*")
    once = marked.join(judged.where("not goes"), same, "left_semi").dropDuplicates(["doc", "th"]).select("row.*")
    return stay.unionByName(once)
