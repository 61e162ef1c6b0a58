"""Document fingerprints from prefix polynomial hashes.

The hash of a text's first i code points, kept for every i, gives the hash of any span by a subtraction and a shift:
spans are compared in constant time, longest common extensions are found by binary search. The arithmetic is modulo
the prime 2^31 - 1 with two bases. A fingerprint is the length, the hash of the whole text and a sample of the hashes
of all its spans of WIDTH code points: the K smallest after mixing, which estimate how alike two texts' span sets are.

Documents are compared with their successor by doc_id: rows are dealt out by ranges of doc_id and text hash, and every
range also gets the first row of the next one; only the bounds of ranges are known to the driver.

Defined cases: null is the empty text, whose sample is empty, like only to another empty text; texts shorter than
WIDTH have one span; rows without doc_id come last, rows that repeat one are ordered by their texts' hash; the last
row's successor is the first row, a single row's itself; texts of any length are read whole; an empty table gives no
rows; extra columns are passed over, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, mix

#: Fixed value: the modulus. Two bases, code points to a span, hashes in a sample.
PRIME, BASES, WIDTH, K = (1 << 31) - 1, (911382323, 972663749), 24, 128
#: Rows to a range, rows of a sample to each bound.
RANGE_ROWS, DRAWN = 2000, 20


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^62."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


class Powers:
    """Powers of the bases and of their inverses, as many as were needed so far."""

    def __init__(self) -> None:
        self.n = 0
        self.up: list[np.ndarray] = [np.ones(1, np.uint64) for _ in BASES]
        self.down: list[np.ndarray] = [np.ones(1, np.uint64) for _ in BASES]
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        while self.n < n + 1:
            for table, roots in ((self.up, BASES), (self.down, [pow(b, PRIME - 2, PRIME) for b in BASES])):
                for i, root in enumerate(roots):
                    step = np.uint64(pow(root, len(table[i]), PRIME))
                    table[i] = np.concatenate([table[i], _mod(table[i] * step)])
            self.n = len(self.up[0])


class Prefixes:
    """Prefix hashes of one text."""

    def __init__(self, text: str, powers: Powers):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n, self.powers = len(self.codes), powers
        powers.grow(self.n)
        values = self.codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for up in powers.up:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_mod(values * up[: self.n]), out=s[1:])
            self.sums.append(_mod(s))

    def prefix(self, i: int) -> tuple[int, ...]:
        return tuple(int(s[i]) for s in self.sums)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Hash of the code points from i to j, wherever they stand."""
        return tuple((int(s[j]) - int(s[i])) * int(down[i]) % PRIME for s, down in zip(self.sums, self.powers.down, strict=True))

    def spans(self, end: int | None = None) -> np.ndarray:
        """Mixed hashes of all spans of WIDTH code points that end by `end`."""
        m = (self.n if end is None else end) - WIDTH + 1
        if m <= 0:
            return np.empty(0, np.uint32)
        hi, lo = (_mod(_mod(s[WIDTH : WIDTH + m] + np.uint64(PRIME) - s[:m]) * down[:m]) for s, down in zip(self.sums, self.powers.down, strict=True))
        return (mix((hi << np.uint64(31)) | lo) >> np.uint64(32)).astype(np.uint32)


def extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common extension of a from i and b from j."""
    return longest(min(a.n - i, b.n - j), lambda m: a.span(i, i + m) == b.span(j, j + m))


def longest(most: int, same: Callable[[int], bool]) -> int:
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if same(middle) else (low, middle - 1)
    return low


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The K smallest distinct hashes, sorted."""
    take = 4 * K
    while take < len(hashes):
        first = np.unique(np.partition(hashes, take)[:take])
        if len(first) >= K:
            return first[:K]
        take *= 8
    return np.unique(hashes)[:K]


class Edited:
    """A text whose end from `keep` on is replaced by the first `n - keep` code points of another, hash by hash."""

    def __init__(self, a: Prefixes, b: Prefixes):
        self.a, self.b = a, b
        self.keep, self.more = a.n - a.n // 2, min(a.n // 2, b.n)
        self.n = self.keep + self.more

    def prefix(self, i: int) -> tuple[int, ...]:
        if i <= self.keep:
            return self.a.prefix(i)
        return tuple((x + y * int(up[self.keep])) % PRIME for x, y, up in zip(self.a.prefix(self.keep), self.b.prefix(i - self.keep), self.a.powers.up, strict=True))

    def seam(self) -> np.ndarray:
        return np.concatenate([self.a.codes[max(0, self.keep - WIDTH + 1) : self.keep], self.b.codes[: min(self.more, WIDTH - 1)]])


def _decoded(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _printed(n: int, whole: tuple[int, ...], sample: np.ndarray) -> str:
    return f"{n:x}.{whole[0]:08x}{whole[1]:08x}." + sample.astype(">u4").tobytes().hex()


def _short(n: int, whole: tuple[int, ...]) -> np.ndarray:
    return (mix(np.array([n * PRIME * 4 + whole[0] + 1, whole[1]][:1] if n else [], np.uint64)) >> np.uint64(32)).astype(np.uint32)


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints' span sets; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(".")[2]), ">u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[:K]
    return float(np.isin(union, x).astype(int) @ np.isin(union, y).astype(int) / len(union))


def fingerprint(p: Prefixes, spans: np.ndarray | None = None) -> str:
    whole = p.prefix(p.n)
    return _printed(p.n, whole, smallest(p.spans() if spans is None else spans) if p.n >= WIDTH else _short(p.n, whole))


def edited_fingerprint(e: Edited, a_spans: np.ndarray, b_spans: np.ndarray) -> str:
    """From the parts' prefix hashes; only spans across the seam are hashed anew."""
    whole = e.prefix(e.n)
    if e.n < WIDTH:
        return _printed(e.n, whole, _short(e.n, whole))
    parts = [smallest(x) for x in (a_spans[: max(0, e.keep - WIDTH + 1)], b_spans[: max(0, e.more - WIDTH + 1)])]
    return _printed(e.n, whole, smallest(np.concatenate([*parts, Prefixes(_decoded(e.seam()), e.a.powers).spans()])))


def with_successors(documents: DataFrame) -> DataFrame:
    """(range, extra, doc_id, text), sorted within partitions; extra: 1 for the row that follows the range's last."""
    key = F.struct(F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    docs = documents.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = docs.select("key")
    rows = keys.count()
    side = 1
    while side * side * RANGE_ROWS < rows and side < 256:
        side += 1
    n = side * side
    # ids may repeat and miss, so bounds are of whole keys: quantiles of at most about DRAWN * n rows
    drawn = sorted(tuple(r[0]) for r in keys.sample(min(1.0, DRAWN * n / max(rows, 1)), 1).collect()) if n > 1 else []
    last = (2, 0, 0)
    bounds = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else [last] * (n - 1)
    coarse, fine = bounds[side - 1 :: side], [bounds[i * side : i * side + side - 1] for i in range(side)]
    key_type = "array<struct<none: bigint, id: bigint, h: bigint>>"
    of = lambda values: F.array(*[F.struct(*map(F.lit, v)) for v in values]).cast(key_type)
    at = lambda values: F.size(F.filter(values, lambda b: b <= F.col("key")))  # noqa: E731  two searches of few bounds each
    placed = lambda df: df.withColumn("c", at(of(coarse))).withColumn("range", (F.col("c") * side + at(F.element_at(F.array(*map(of, fine)), F.col("c") + 1))).cast("int")).drop("c")
    heads = {r[0]: tuple(r[1]) for r in placed(keys).groupBy("range").agg(F.min("key")).collect()}  # a row for each range
    filled = sorted(heads)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}
    head, previous = of([heads.get(i, last) for i in range(n)]), F.array(*[F.lit(before.get(i, -1)) for i in range(n)])
    docs = placed(docs)
    also = docs.where(F.col("key") == F.element_at(head, F.col("range") + 1)).select(F.element_at(previous, F.col("range") + 1).alias("range"), F.lit(1).alias("extra"), "key", "doc_id", "text")
    both = docs.select("range", F.lit(0).alias("extra"), "key", "doc_id", "text").union(also)
    return both.repartitionById(n, F.col("range")).sortWithinPartitions("range", "extra", "key", "text").drop("key")


def fingerprinted(documents: DataFrame) -> DataFrame:
    """Of every row: doc_id, n_chars, fingerprint, the same of the edited text, likenesses, and the common prefixes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for where, extra, doc, text in zip(*(batch.column(c).to_pylist() for c in ("range", "extra", "doc_id", "text")), strict=True):
                text = text or ""
                if held and held[0] != where:
                    held = None
                if extra and not held:
                    continue
                if held and held[2] == text:
                    p, spans, printed = held[3:]
                else:
                    p = Prefixes(text, powers)
                    spans = p.spans()
                    printed = fingerprint(p, spans)
                if held:
                    _, own, own_text, a, a_spans, a_printed = held
                    e = Edited(a, p)
                    changed = edited_fingerprint(e, a_spans, spans)
                    common = longest(min(a.n, e.n), lambda m, a=a, e=e: a.prefix(m) == e.prefix(m))
                    out.append((own, a.n, hashlib.sha256((own_text[: e.keep] + text[: e.more]).encode("utf-8", "surrogatepass")).hexdigest(), a_printed, changed, likeness(a_printed, changed), likeness(a_printed, printed), common, extension(a, 0, p, 0)))
                held = None if extra else (where, doc, text, p, spans, printed)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)

    return map_text(with_successors(documents), rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long")
