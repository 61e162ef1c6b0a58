"""From band buckets to verified components, without all pairs of a bucket and without a bucket in one task.

1. `grouped`: tasks send bucket entries packed, many to a row. Buckets of at most WHOLE members that have the same
   smallest member make one set. Of a larger bucket, each task joins what it holds to its smallest member and sends one
   entry onward, so a bucket of any size costs a task one entry; these chains lead to the bucket's hub.
2. `set_links`: the members of every set are compared with each other, unless links that the task has found connect them.
3. Large buckets: members are verified against their hubs; then those that still hold several components have every
   member outside the most frequent component compared with all others, in tiles of bounded size. So no pair that
   shares a bucket goes unseen unless it is already connected, and what is written stays in proportion to the members.
4. `components`: star rounds over the links; a task's links travel as stars, so most components need few rounds.

What a hot bucket, hub or component is joined to is written before, so that both sides of the join are plain exchanges:
only then adaptive execution can split the hot key's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, scratch

#: Bucket entries (16 bytes each) that a task holds before it sends them on, and that one reducing task gets on average.
HELD, REDUCED = 1_500_000, 1_500_000
#: Members of a bucket, from one task or in all, that stay together; larger ones go by way of a hub. Rows on a side of a tile.
WHOLE, TILE = 64, 256
#: Pairs of members that are looked at without regard to their registers, pairs that are looked at together.
FEW, TOGETHER = 144, 20_000


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and how long they are."""
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def pack(entries: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """(bucket keys, member ids) to rows (part, own, heads, chained).

    own: a task's (bucket, member) of buckets that it has few of; heads: its (bucket, smallest member) of others, and
    chained: what it joined to these as (bucket, member, smallest member).
    """

    def flush(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        starts, counts = _runs(keys)
        large = counts > WHOLE
        least = np.minimum.reduceat(ids, starts)
        few = np.repeat(~large, counts)
        hub = np.repeat(least, counts)
        away = ~few & (ids != hub)
        local = np.stack([keys[away].view(np.int64), ids[away], hub[away]], 1)

        def dealt(keys: np.ndarray, ids: np.ndarray) -> list[bytes]:
            to = (keys % np.uint64(parts)).astype(np.int64)
            by_part = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by_part], np.arange(parts + 1))
            rows = np.stack([keys.view(np.int64), ids], 1)[by_part]
            return [rows[cuts[p] : cuts[p + 1]].tobytes() for p in range(parts)]

        own, heads = dealt(keys[few], ids[few]), dealt(keys[starts[large]], least[large])
        # chains need no further grouping: they are dealt out evenly
        share = np.linspace(0, len(local), parts + 1).astype(int)
        rows = [(p, own[p], heads[p], local[share[p] : share[p + 1]].tobytes()) for p in range(parts)]
        rows = [r for r in rows if any(r[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(4)], ["part", "own", "heads", "chained"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for keys, ids in entries:
        held.append((keys, ids))
        n += len(keys)
        if n >= HELD:
            yield flush(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield flush(*map(np.concatenate, zip(*held, strict=True)))


PACKED = "part int, own binary, heads binary, chained binary"


def parts_for(entries: int) -> int:
    return max(16, -(-entries // REDUCED))


def _different(rows: np.ndarray) -> np.ndarray:
    """Rows sorted by their first column, then the second, without repeated ones."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))] if len(rows) else rows


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches), pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("own", "heads", "chained")]]))
    own, heads, chained = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64).reshape(-1, k) for c, k in (("own", 2), ("heads", 2), ("chained", 3)))
    got = np.concatenate([own, heads])
    order = np.argsort(got[:, 0])
    got = got[order]
    _, counts = _runs(got[:, 0])
    # most buckets have one member; one that several tasks send is one
    got = _different(got[np.repeat(counts > 1, counts) | (order >= len(own))])
    starts, counts = _runs(got[:, 0])
    large = np.repeat((counts > WHOLE) | np.isin(got[starts, 0], heads[:, 0]), counts)
    rows = np.column_stack([got, np.repeat(got[starts, 1], counts)])
    rest = rows[:, 1] != rows[:, 2]
    few, hubs = _different(rows[rest & ~large][:, [2, 1]]), np.concatenate([rows[rest & large], chained])
    columns = [pa.concat_arrays([x, pa.array(hubs[:, i])]) for i, x in enumerate((pa.nulls(len(few), pa.int64()), pa.array(few[:, 1]), pa.array(few[:, 0])))]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "id", "hub"])


def grouped(packed: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Sets, (hub, id) of small buckets by their smallest member, and links (bucket, id, hub) of the chains of large ones; written."""
    found = scratch(packed.repartitionById(parts, F.col("part")).mapInArrow(_reduce, "bucket long, id long, hub long"), "buckets")
    return scratch(found.where("bucket is null").select("hub", "id").distinct(), "sets"), found.where("bucket is not null")


def members(sets: DataFrame, links: DataFrame) -> DataFrame:
    both = sets.union(links.select("hub", "id"))
    return both.select("id").union(both.select("hub")).distinct()


class Joined:
    """Components that have been joined meanwhile (union-find); the smallest member is a component's name."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x

    def stars(self) -> pa.RecordBatch:
        """(a, b): b's component is a."""
        return _links([(self.find(x), x) for x in self.up])


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


#: A member: its id, then what a comparison makes of its other columns.
Member = tuple


class Comparison:
    """How members are compared.

    columns: what their payload has besides id; same: whether two members are linked, exactly; likely: of many pairs, a
    figure each, the largest to be looked at first, or None for those that need no look. Where members meet in more than
    FEW pairs, these must agree in a share `least` of their registers to be looked at; without registers all are.
    """

    columns: tuple[str, ...] = ("text",)
    least = 0.0

    def members(self, batch: pa.RecordBatch) -> list[Member]:
        return list(zip(*(batch.column(c).to_pylist() for c in ("id", *self.columns)), strict=True))

    def same(self, a: Member, b: Member) -> bool:
        raise NotImplementedError

    def registers(self, members: list[Member]) -> np.ndarray:
        return np.zeros((len(members), 1), np.uint8)

    def likely(self, a: list[Member], b: list[Member]) -> list[float | None]:
        return [0.0] * len(a)

    def stream(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of rows sorted by tile (k1, k2, k3) to links. A tile may go on in the next batch."""
        joined = Joined()
        waiting: list[tuple[Member, Member, int, int]] = []

        def look() -> None:
            figures = self.likely([w[0] for w in waiting], [w[1] for w in waiting])
            for k in sorted((k for k, f in enumerate(figures) if f is not None), key=lambda k: -figures[k]):
                x, y, c, d = waiting[k]
                if joined.find(c) != joined.find(d) and self.same(x, y):
                    joined.join(c, d)
            waiting.clear()

        def compare(side: np.ndarray, component: list[int], members: list[Member]) -> None:
            """Members of side 0 with those of side 1, or all of side 2 with each other."""
            left, right = np.flatnonzero(side != 1).tolist(), np.flatnonzero(side != 0)
            many = len(left) * len(right) > FEW
            roots = np.array([joined.find(c) for c in component])
            regs = self.registers(members) if many else None
            for i in left:
                at = right[right > i] if side[i] == 2 else right
                at = at[roots[at] != roots[i]]
                if many and len(at):
                    at = at[(regs[at] == regs[i]).mean(1) >= self.least]
                waiting.extend((members[i], members[j], component[i], component[j]) for j in at.tolist())
                if len(waiting) >= TOGETHER:
                    look()

        held: tuple[np.ndarray, list[Member]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.column_stack([batch.column(c).to_numpy() for c in ("k1", "k2", "k3", "side", "component")])
            members = self.members(batch)
            if held:
                numbers, members = np.concatenate([held[0], numbers]), held[1] + members
            cuts = [0, *(np.flatnonzero((numbers[1:, :3] != numbers[:-1, :3]).any(1)) + 1).tolist()]
            for i, j in zip(cuts, cuts[1:], strict=False):
                compare(numbers[i:j, 3], numbers[i:j, 4].tolist(), members[i:j])
            held = numbers[cuts[-1] :], members[cuts[-1] :]
        if held:
            compare(held[0][:, 3], held[0][:, 4].tolist(), held[1])
        look()
        yield joined.stars()

    def verified(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (a, b, left, right), payloads of both with their ids, to those that are linked."""
        for batch in batches:
            left, right = (self.members(pa.RecordBatch.from_arrays(batch.column(c).flatten(), ["id", *self.columns])) for c in ("left", "right"))
            yield _links([(x[0], y[0]) for x, y, f in zip(left, right, self.likely(left, right), strict=True) if f is not None and self.same(x, y)])


def set_links(sets: DataFrame, payload: DataFrame, comparison: Comparison) -> DataFrame:
    """Links (a, b) between members of small buckets: of those that have the same smallest member, which is in few buckets, all meet."""
    each = sets.union(sets.select("hub", F.col("hub").alias("id")).distinct()).join(payload.select("id", *comparison.columns), "id")
    each = each.select(F.col("hub").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.lit(2).alias("side"), "id", F.col("id").alias("component"), *comparison.columns)
    return map_text(each.repartition("k1").sortWithinPartitions("k1"), comparison.stream, "a long, b long")


def hub_links(links: DataFrame, payload: DataFrame, comparison: Comparison) -> DataFrame:
    """Links (a, b) of members and the hub that they share most large buckets with; what this leaves apart, tile_links sees."""
    hubs = scratch(links.groupBy("id", "hub").count().groupBy("id").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("a")).select("a", F.col("id").alias("b")), "hubs")
    left, right = (payload.select(F.col("id").alias(c), F.struct("id", *comparison.columns).alias(side)) for c, side in (("a", "left"), ("b", "right")))
    return map_text(hubs.join(right, "b").join(left, "a").select("a", "b", "left", "right"), comparison.verified, "a long, b long")


def tile_links(links: DataFrame, joined: DataFrame, payload: DataFrame, comparison: Comparison) -> DataFrame:
    """Links (a, b) between components that meet in a large bucket; joined: (id, component) so far."""
    each = links.select("bucket", "id").union(links.select("bucket", "hub")).distinct()
    each = scratch(each.join(joined, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "members")
    counted = each.groupBy("bucket", "component").count()
    sizes = counted.groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    each = each.join(scratch(sizes.where("n > most"), "sizes"), "bucket")
    minor, tiles = F.col("component") != F.col("main"), lambda n: F.ceil(n / TILE).cast("int")
    a_tiles, b_tiles = tiles(F.col("n") - F.col("most")), tiles(F.col("n"))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    a = each.where(minor).select(F.col("bucket").alias("k1"), place(a_tiles).alias("k2"), F.explode(F.sequence(F.lit(0), b_tiles - 1)).alias("k3"), F.lit(0).alias("side"), "id", "component")
    b = each.select(F.col("bucket").alias("k1"), F.explode(F.sequence(F.lit(0), a_tiles - 1)).alias("k2"), place(b_tiles).alias("k3"), F.lit(1).alias("side"), "id", "component")
    rows = a.union(b).join(payload.select("id", *comparison.columns), "id").repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3")
    return map_text(rows, comparison.stream, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component: smallest id that links lead to) of any links (a, b), by alternating large-star and small-star rounds.

    Every round is one pre-aggregated minimum a node and a join back that Spark may split where a node is hot, as the
    minima are written before it; each step is written, so that lineage stays short. Written.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = scratch(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return scratch(out.where("u <> v").distinct(), "stars")

    def done(pairs: DataFrame) -> bool:
        """Whether every node leads to one, which leads nowhere."""
        roles = pairs.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("end")).union(pairs.select("v", F.lit(0), F.lit(1)))
        return roles.groupBy("x").agg(F.sum("n").alias("n"), F.max("end").alias("end")).where("n > 1 or n = 1 and end = 1").isEmpty()

    pairs = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not done(pairs):
        # a large star's links lead from greater to smaller ids already
        pairs = star(star(pairs, True), False)
    return scratch(pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "joined")


def merged(joined: DataFrame, more: DataFrame) -> DataFrame:
    """Components (id, component) after further links (a, b), whose ends need not be among them yet.

    A component's name is its smallest id, so the smallest name of those that are linked is the smallest id again.
    """
    for c in ("a", "b"):
        name = joined.select(F.col("id").alias(c), F.col("component").alias("name"))
        more = more.join(name, c, "left").withColumn(c, F.coalesce("name", c)).drop("name")
    names = components(more)
    renamed = joined.join(names.select(F.col("id").alias("component"), F.col("component").alias("name")), "component", "left").select("id", F.coalesce("name", "component").alias("component"))
    return scratch(renamed.union(names.join(joined, "id", "left_anti").select("id", "component")), "joined")


def connected(sets: DataFrame, links: DataFrame, payload: DataFrame, comparison: Comparison) -> DataFrame:
    """(id, component) of all members that have a link; payload: a row for each id of members(), written."""
    edges = set_links(sets, payload, comparison)
    large = not links.isEmpty()
    if large:
        edges = edges.union(hub_links(links, payload, comparison))
    joined = components(edges)
    if large:
        more = scratch(tile_links(links, joined, payload, comparison), "linked")
        if not more.isEmpty():
            joined = merged(joined, more)
    return joined
