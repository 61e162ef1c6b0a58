"""Line dedup: fuzzy lines by MinHash over character shingles.

Lines are stripped of white space at their ends; blank ones stay where they are. Equal lines are one member. Members
whose band keys meet are verified by the exact Jaccard similarity of their shingle sets (8 code points; a shorter line
is one shingle) and joined by a distributed union-find. Of each component the first line stays: that of the smallest
(doc_id, text hash, line number); all others go from their documents. One changed character inside a line changes 8
shingles, so lines of under 79 code points are only alike if they are equal or differ near their ends.

Defined cases: null and empty texts have no lines and stay as they are; rows without doc_id come last; rows that
repeat both doc_id and text are one document, and keep the same lines; ties cannot be, as a place is a line's own;
texts and lines of any length are looked at whole; an empty table gives none; extra columns are carried through
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linkage
from .common import filter_of, jaccard_at_least, map_text, mix, scratch, texts

#: Code points to a shingle, similarity in hundredths, bands and rows: a pair at 0.8 is missed with probability 0.0006.
WIDTH, PER_CENT, BANDS, ROWS = 8, 80, 14, 4
#: Registers that lines which meet many others are first compared by (the first ones are the bands'), and the least
#: share of equal ones: six standard errors below the threshold.
REGISTERS, LEAST = 256, 0.65
#: Code points that are hashed at a time (they stay in the processor's cache), lines that a task remembers.
CHUNK, REMEMBERED = 1 << 16, 1_000_000
#: What stands between lines: no code point.
GAP = 0x110000
_DRAWN = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
TIMES, SALT = _DRAWN[:REGISTERS] | np.uint32(1), _DRAWN[REGISTERS:]


def line_hash(line: str) -> int:
    """A signed 64-bit hash of a stripped line."""
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def signatures(lines: list[str], registers: int = BANDS * ROWS) -> np.ndarray:
    """MinHash registers of many lines at once, a row each."""
    out = np.empty((len(lines), registers), np.uint32)
    gap, at = "\0" * (WIDTH - 1), 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (size < CHUNK or end == at):
            size += len(lines[end]) + WIDTH - 1
            end += 1
        codes = np.frombuffer((gap.join(lines[at:end]) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes) - WIDTH + 1
        h = np.full(n, 1, np.uint32)
        for i in range(WIDTH):
            h *= np.uint32(0x01000193)
            h ^= codes[i : i + n]
        for shift, times in ((15, 0x2C1B3C6D), (12, 0x297A2D39), (15, 1)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(times)
        lengths = np.array([len(x) for x in lines[at:end]])
        starts = np.concatenate(([0], np.cumsum(lengths + WIDTH - 1)[:-1]))
        # a line's shingles, then what lies between two lines; the last line's end is the array's
        cuts = np.stack([starts, starts + np.maximum(lengths - WIDTH + 1, 1)], 1).ravel()
        cuts = cuts[:-1] if cuts[-1] >= n else cuts
        g = np.empty_like(h)
        for r in range(registers):
            np.bitwise_xor(h, SALT[r], out=g)
            np.multiply(g, TIMES[r], out=g)
            out[at:end, r] = np.minimum.reduceat(g, cuts)[::2]
        at = end
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    x = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(48), x.shape[:2])
    for i in range(ROWS):
        keys = mix(keys + x[:, :, i] + np.uint64(1))
    return keys


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each line's shingles, of many lines at once."""
    out, at = [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (size < CHUNK or end == at):
            size += len(lines[end]) + WIDTH - 1
            end += 1
        lengths = np.array([len(x) for x in lines[at:end]])
        starts = np.concatenate(([0], np.cumsum(lengths + WIDTH - 1)[:-1]))
        codes = np.full(size, GAP, np.uint64)  # between lines, and after the last
        codes[np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)] = np.frombuffer("".join(lines[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = size - WIDTH + 1
        h = np.zeros(n, np.uint64)
        for i in range(WIDTH):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += codes[i : i + n]
        h = mix(h)
        for a, k in zip(starts.tolist(), np.maximum(lengths - WIDTH + 1, 1).tolist(), strict=True):
            own = np.sort(h[a : a + k])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        at = end
    return out


def shingles(line: str) -> np.ndarray:
    return shingle_sets([line])[0]


def split(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n")]


def _keyed(documents: DataFrame) -> DataFrame:
    """doc and h (of the text) say which document a line is of."""
    return documents.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("h"), "text")


def in_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different entries sorted by hash, then place, and which of them are the first of their hash."""
    x = x[np.argsort(x[:, 0])]
    first = np.concatenate(([True], x[1:, 0] != x[:-1, 0]))[: len(x)]
    several = ~first
    several[:-1] |= ~first[1:]  # most lines stand in one place only
    own = x[several]
    x[several] = own[np.lexsort((own[:, 4], own[:, 3], own[:, 2], own[:, 1], own[:, 0]))]
    # rows that are repeated whole have the same places
    again = np.concatenate(([False], (x[1:] == x[:-1]).all(1)))[: len(x)]
    return x[~again], first[~again]


def placed(documents: DataFrame, parts: int) -> DataFrame:
    """Where lines stand, packed: of each line the first place in a task, and the places that are not the first there.

    The former go to the part of the line's hash, so a line of any frequency sends one entry a task; the latter are
    dropped whatever the others hold, and are dealt out evenly. An entry is (hash, no doc_id, doc, h, line).
    """

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        x, first = in_order(np.concatenate(held))
        own, later = x[first], x[~first]
        part = (own[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        own, part = own[np.argsort(part, kind="stable")], np.sort(part)
        cuts, share = np.searchsorted(part, np.arange(parts + 1)), np.linspace(0, len(later), parts + 1).astype(int)
        return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([own[cuts[p] : cuts[p + 1]].tobytes() for p in range(parts)], pa.binary()), pa.array([later[share[p] : share[p + 1]].tobytes() for p in range(parts)], pa.binary())], ["part", "firsts", "laters"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            hashes, numbers, counts = [], [], []
            for text in texts(batch):
                own = split(text)
                full = [k for k, x in enumerate(own) if x]
                hashes += [line_hash(own[k]) for k in full]
                numbers += full
                counts.append(len(full))
            if hashes:
                doc, h = batch.column("doc"), batch.column("h").to_numpy()
                by_row = np.column_stack([doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), h])
                held.append(np.column_stack([np.array(hashes, np.int64), np.repeat(by_row, counts, axis=0), np.array(numbers, np.int64)]))
                n += len(hashes)
            if n > REMEMBERED:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return map_text(_keyed(documents), rows, "part int, firsts binary, laters binary")


def gone_and_open(places: DataFrame, named: DataFrame, parts: int) -> DataFrame:
    """(hash, no, doc, h, line, first): places of lines after the line's first, and the first places of lines that are named (id); written.

    A line's later places go whatever other lines it is like; its first one stays or goes by its component.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            part = (ids.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            ids, cuts = ids[np.argsort(part, kind="stable")], np.searchsorted(np.sort(part), np.arange(parts + 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([ids[cuts[p] : cuts[p + 1]].tobytes() for p in range(parts)], pa.binary())], ["part", "named"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("firsts", "laters", "named")]]))
        x, later, ids = (np.frombuffer(b"".join(v for v in rows.column(c).to_pylist() if v), np.int64) for c in ("firsts", "laters", "named"))
        x, first = in_order(x.reshape(-1, 5))
        later = later.reshape(-1, 5)
        kept = ~first | np.isin(x[:, 0], ids)
        out = np.concatenate([x[kept], later])
        first = np.concatenate([first[kept], np.zeros(len(later), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1] > 0), pa.array(out[:, 2]), pa.array(out[:, 3]), pa.array(out[:, 4].astype(np.int32)), pa.array(first)], ["hash", "no", "doc", "h", "line", "first"])

    ids = named.select("id").mapInArrow(pack, "part int, named binary")
    both = places.withColumn("named", F.lit(None).cast("binary")).union(ids.select("part", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "named"))
    return scratch(both.repartitionById(parts, F.col("part")).mapInArrow(reduce, "hash long, no boolean, doc long, h long, line int, first boolean"), "places")


def banded(documents: DataFrame, parts: int) -> DataFrame:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen: set[int] = set()
        for batch in batches:
            new = {}
            for text in texts(batch):
                for x in split(text):
                    if x and (h := line_hash(x)) not in seen:
                        seen.add(h)
                        new[h] = x
            if len(seen) > REMEMBERED:
                seen.clear()
            if new:
                yield band_keys(signatures(list(new.values()))).ravel(), np.repeat(np.fromiter(new, np.int64, len(new)), BANDS)

    return map_text(documents.select("text"), lambda batches: linkage.pack(entries(batches), parts), linkage.PACKED)


def line_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the lines wanted (id); written.

    A filter of them goes to every task and keeps most other lines where they are. It has no false misses and is of
    bounded size: where it gets full, more lines travel, and the join decides.
    """
    passes = filter_of(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = {h: x for text in texts(batch) for x in split(text) if x and (h := line_hash(x)) not in seen}
            hashes = np.fromiter(new, np.int64, len(new))
            ids = hashes[passes(hashes)].tolist() if len(new) else []
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([new[h] for h in ids], pa.string())], ["id", "text"])

    found = map_text(documents.select("text"), rows, "id long, text string")
    return scratch(found.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "candidates")


class Lines(linkage.Comparison):
    """Lines are linked by the exact similarity of their shingle sets."""

    least = LEAST

    def members(self, batch: pa.RecordBatch) -> list[linkage.Member]:
        lines = batch.column("text").to_pylist()
        return list(zip(batch.column("id").to_pylist(), lines, shingle_sets(lines), strict=True))

    def registers(self, members: list[linkage.Member]) -> np.ndarray:
        return signatures([m[1] for m in members], REGISTERS).astype(np.uint8)

    def same(self, a: linkage.Member, b: linkage.Member) -> bool:
        return jaccard_at_least(a[2], b[2], PER_CENT)


def dropped_lines(documents: DataFrame) -> DataFrame:
    """(no, doc, h, drop): the numbers of each document's lines that an earlier line stands for."""
    parts = max(16, 2 * documents.select("text").rdd.getNumPartitions())  # so what a part gets is bounded by a split's size
    sets, links = linkage.grouped(banded(documents, parts), parts)
    payload = line_texts(documents, scratch(linkage.members(sets, links), "members"))
    joined = linkage.connected(sets, links, payload, Lines())
    found = gone_and_open(placed(documents, parts), joined, parts)
    place = ["no", "doc", "h", "line"]
    named = found.where("first").join(joined.withColumnRenamed("id", "hash"), "hash")
    stays = named.groupBy("component").agg(F.min(F.struct(*place)).alias("stays")).select("stays.*")
    # by place, which is a line's own: no component meets in a task
    gone = found.where("first").select(place).join(stays, place, "left_anti").union(found.where("not first").select(place))
    return gone.groupBy("no", "doc", "h").agg(F.collect_set("line").alias("drop"))


def deduplicated(documents: DataFrame, counts: tuple[str, str] = ("n_lines_", "n_kept_")) -> DataFrame:
    """The rows of documents with text rewritten, and how many lines that are not blank they have and keep."""
    names, dropped = documents.columns, dropped_lines(documents)
    # the row is one column, so no name of its columns can clash
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc"), F.xxhash64("row.text").alias("h"))
    dropped = dropped.select(F.expr("if(no, null, doc)").alias("d"), F.col("h").alias("k"), "drop")
    rows_in = keyed.join(dropped.hint("shuffle_hash"), F.expr("doc <=> d and h = k"), "left").select("row", "drop")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lines, kept = [], [], []
            columns = dict(zip(names, batch.column("row").flatten(), strict=True))
            for text, drop in zip(columns["text"].to_pylist(), batch.column("drop").to_pylist(), strict=True):
                gone = set(drop or ())
                own = (text or "").split("\n")
                full = sum(1 for x in own if x.strip())
                out.append("\n".join([x for k, x in enumerate(own) if k not in gone]) if gone else text)
                lines.append(full)
                kept.append(full - len(gone))
            columns["text"] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(list(columns.values()), names), pa.array(lines, pa.int64()), pa.array(kept, pa.int64())], ["row", "lines", "kept"])

    schema = T.StructType([T.StructField("row", T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema])), T.StructField("lines", T.LongType()), T.StructField("kept", T.LongType())])
    return map_text(rows_in, rows, schema).select("row.*", F.col("lines").alias(counts[0]), F.col("kept").alias(counts[1]))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and the sha256 of the remaining text of every row."""
    found = deduplicated(documents.select("doc_id", "text"), ("n_lines", "n_kept"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
