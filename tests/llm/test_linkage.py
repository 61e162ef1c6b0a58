"""Components of links against a union-find on the driver."""

import random

import numpy as np
import pytest

pytest.importorskip("chunkmill.llm")
from chunkmill.llm import linkage

LINKS = "a long, b long"


def smallest(links):
    up = {x: x for link in links for x in link}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def found(components):
    rows = components.collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.component for r in rows}


def test_components(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(40)]
    hub = [(-5, i) for i in range(100, 160)]
    deep = [(draw.randrange(200, i), i) for i in range(201, 260)]
    loops = [(7, 7), (300, 301), (301, 300), (302, 301), (300, 302)]
    links = chain + hub + deep + loops
    assert found(linkage.components(spark.createDataFrame(links, LINKS))) == {k: v for k, v in smallest(links).items() if k != 7 or v != 7}
    assert found(linkage.components(spark.createDataFrame([], LINKS))) == {}


def test_merged(spark):
    draw = random.Random(4)
    links = [(draw.randrange(i // 5 * 5, i), i) for i in range(100) if i % 5]
    # loops, repeats, both directions, and members that no link had before
    more = [(7, 93), (93, 7), (12, 12), (44, 31), (31, 60), (60, 44), (200, 201), (-3, 88), (202, 12)]
    joined = linkage.components(spark.createDataFrame(links, LINKS))
    assert found(linkage.merged(joined, spark.createDataFrame(more, LINKS))) == smallest(links + more)
    assert found(linkage.components(spark.createDataFrame(links + more, LINKS))).items() <= smallest(links + more).items()


def test_connected(spark, monkeypatch):
    """Buckets of any size, a member in several of them or repeated: at least the links of all pairs that share one, and no others."""
    class Near(linkage.Comparison):
        """Numbers are linked if they differ by one at most."""

        columns = ("value",)

        def same(self, a, b):
            return abs(a[1] - b[1]) <= 1

    draw = random.Random(5)
    monkeypatch.setattr(linkage, "TILE", 32)
    values = {i - 200: draw.randrange(700) for i in range(600)}
    buckets = {k: draw.sample(sorted(values), n) for k, n in enumerate([2, 2, 3, 5, 40, 64, 65, 300, 7, 1, 0, 150])}
    buckets[20] = buckets[3]
    rows = [(b, i) for b, own in buckets.items() for i in own for _ in range(1 + (i % 3 == 0))]
    draw.shuffle(rows)

    def packed(batches):
        for batch in batches:
            keys, ids = (batch.column(c).to_numpy() for c in ("bucket", "id"))
            yield from linkage.pack(((keys[k : k + 90].view(np.uint64), ids[k : k + 90]) for k in range(0, len(keys), 90)), 3)

    sets, links = linkage.grouped(spark.createDataFrame(rows, "bucket long, id long").repartition(3).mapInArrow(packed, linkage.PACKED), 3)
    assert not sets.isEmpty() and not links.isEmpty()
    payload = spark.createDataFrame(list(values.items()), "id long, value long").join(linkage.members(sets, links), "id", "left_semi")
    near = lambda own: [(a, b) for a in own for b in own if a < b and abs(values[a] - values[b]) <= 1]
    least, most = smallest([p for own in buckets.values() for p in near(own)]), smallest(near(sorted({i for own in buckets.values() for i in own})))
    got = found(linkage.connected(sets, links, payload, Near()))
    assert least.keys() <= got.keys() <= most.keys()
    assert all(got[i] == got[c] and most[i] == most[got[i]] for i, c in least.items())
