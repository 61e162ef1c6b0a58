"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with block-max inverted indexes.

Terms are all words of the labelled examples. A text's weight of a term is (1 + ln count) * idf * chi-square: the
inverse document frequency over all documents, and how far the term's share of toxic examples is from the sample's (the
third factor of supervised term weighting, which keeps every word, but lets random rare ones weigh little).

The index has postings by term, examples being in blocks of alike ones, and of the most frequent terms the greatest
weight in each block. A search adds up the postings of its rarer terms, bounds each block by what it has and the frequent
terms' greatest weights, looks into the blocks of the highest bounds, then into all whose bound reaches the k-th best: the
k nearest are exact. Votes weighted by nearness are made probabilities by isotonic regression on the examples, each judged by the
others; the neighbours are the evidence.

The examples are at most `sample` labelled rows (those of smallest id hash) with at most POSTINGS different words, each
row's own counted; a row that would exceed them is passed over. Counts and scores cover every document.

Defined cases: null and empty texts and those without any term have no neighbours and get the share of toxic
examples among examples without a term; without labels every score is 0.5; ties between neighbours go to the smaller
id; rows that repeat a doc_id are scored by their own text, and as an example the smallest of their texts stands for
them; of different labels of an id the largest counts; texts of any length are read whole; an empty table gives no
rows; extra columns are passed over, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, scratch, ship, texts

#: Bounds of the fit: labelled rows, their different words; neighbours.
SAMPLE, POSTINGS, NEIGHBOURS = 5120, 2_500_000, 25
#: Layout, which changes no result: examples in a block, terms whose weights are kept by block, texts searched together.
BLOCK, COMMON, TOGETHER = 64, 1024, 128
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Examples:
    """Block-max inverted index of labelled examples (id, terms, counts, label), and the calibration of their votes."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[int, list[int], list[int], int]], names: list[str] | None = None):
        self.number = {w: i for i, w in enumerate(names or ())}
        empty = [y for _, t, _, y in rows if not len(t)]
        labelled = np.array([y for *_, y in rows], float)
        prior = float((labelled.sum() + 1) / (len(labelled) + 2))
        self.base = float((sum(empty) + 2 * prior) / (len(empty) + 2))
        rows = [r for r in rows if len(r[1])]
        n, toxic = np.zeros(len(idf)), np.zeros(len(idf))
        for _, t, _, y in rows:
            n[t] += 1
            toxic[t] += y
        self.weight = idf * (toxic - n * prior) ** 2 / (n * prior * (1 - prior) + 1)
        made = [(doc, y, *self.unit(t, c)) for doc, t, c, y in rows]
        # alike examples next to each other, so that blocks have tight bounds
        made.sort(key=lambda r: (int(r[2][np.argmax(r[3])]), r[0]) if len(r[2]) else (-1, r[0]))
        self.ids = np.array([r[0] for r in made], np.int64)
        self.labels = np.array([r[1] for r in made], float)
        self.blocks = -(-len(made) // BLOCK)
        self._index(made)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([prior, prior])
        if made:
            self._calibrate(np.array([v for v, _, _ in self.votes([(t, w) for _, _, t, w in made], np.arange(len(made)))]), prior)

    def _index(self, made: list[tuple]) -> None:
        term = np.concatenate([np.empty(0, np.int64), *[r[2] for r in made]])
        example = np.repeat(np.arange(len(made)), [len(r[2]) for r in made])
        weight = np.concatenate([np.empty(0), *[r[3] for r in made]])
        frequency = np.bincount(term, minlength=len(self.weight))
        common = np.argsort(-frequency, kind="stable")[:COMMON]
        common = np.sort(common[frequency[common] > 1])
        #: A common term's column, -1 for others.
        self.column = np.full(len(self.weight), -1)
        self.column[common] = np.arange(len(common))
        often = self.column[term] >= 0
        self.dense = np.zeros((self.blocks, BLOCK, len(common)))
        self.dense.reshape(self.blocks * BLOCK, len(common))[example[often], self.column[term[often]]] = weight[often]
        self.most = self.dense.max(1) if self.blocks else np.zeros((0, len(common)))
        term, example, weight = term[~often], example[~often], weight[~often]
        order = np.argsort(term, kind="stable")
        self.example, self.posted = example[order].astype(np.int32), weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(self.weight) + 1))

    def unit(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms that weigh something, and their weights in a vector of length 1."""
        t = np.array(terms, np.int64)
        w = (1 + np.log(np.array(counts, float))) * self.weight[t]
        t, w = t[w > 0], w[w > 0]
        return t, w / np.sqrt((w**2).sum()) if len(w) else w

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and cosines of the k nearest of each vector (terms, weights), but for the example at `without`."""
        n, size = len(vectors), self.blocks * BLOCK
        row = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        t, w = np.concatenate([np.empty(0, np.int64), *[t for t, _ in vectors]]), np.concatenate([np.empty(0), *[w for _, w in vectors]])
        often = self.column[t] >= 0
        query = np.zeros((n, self.dense.shape[2]))
        query[row[often], self.column[t[often]]] = w[often]
        t, w, row = t[~often], w[~often], row[~often]
        lengths = self.starts[t + 1] - self.starts[t]
        posts = np.repeat(self.starts[t] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        partial = np.bincount(np.repeat(row * size, lengths) + self.example[posts], self.posted[posts] * np.repeat(w, lengths), n * size).reshape(n, self.blocks, BLOCK)
        if without is not None:
            partial.reshape(n, size)[np.arange(n), without] = -9.0
        bounds = partial.max(2) + query @ self.most.T + 1e-9
        cosine, seen = np.full((n, self.blocks, BLOCK), -9.0), np.zeros(bounds.shape, bool)
        # the best blocks by bound, then what their k-th best leaves open
        first = np.argpartition(-bounds, 1, 1)[:, :2] if self.blocks > 2 else np.broadcast_to(np.arange(self.blocks), bounds.shape)
        look = np.zeros(bounds.shape, bool)
        np.put_along_axis(look, first, True, 1)
        least = np.full(n, 5e-10)
        for _ in range(2):
            for block in np.flatnonzero(look.any(0)).tolist():
                at = np.flatnonzero(look[:, block])
                cosine[at, block] = partial[at, block] + query[at] @ self.dense[block].T
            seen |= look
            found = np.take_along_axis(cosine, first[:, :, None], 1).reshape(n, -1)
            if found.shape[1] >= NEIGHBOURS:
                least = np.maximum(np.partition(found, -NEIGHBOURS, 1)[:, -NEIGHBOURS] - 1e-9, 5e-10)
            look = (bounds >= least[:, None]) & ~seen
        flat = cosine.reshape(n, size)
        for i in range(n):
            at = np.flatnonzero(flat[i] >= least[i])
            near = flat[i, at]
            order = np.lexsort((self.ids[at], -np.round(near, 9)))[:NEIGHBOURS]
            yield at[order], near[order]

    def nearest(self, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return next(self.search([(t, w)]))

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """The share of toxic ones among the nearest, weighted by nearness, and these."""
        for i in range(0, len(vectors), TOGETHER):
            for at, near in self.search(vectors[i : i + TOGETHER], None if without is None else without[i : i + TOGETHER]):
                nearness = 1 / (1.01 - np.minimum(near, 1.0))
                yield (float((nearness * self.labels[at]).sum() / nearness.sum()) if len(at) else self.base), at, near

    def _calibrate(self, votes: np.ndarray, prior: float) -> None:
        """Pool adjacent violators over votes in 20 steps, each smoothed towards the prior."""
        pools: list[list[float]] = []
        for step in range(20):
            inside = (votes >= step / 20) & ((votes < (step + 1) / 20) | (step == 19))
            if inside.any():
                pools.append([self.labels[inside].sum() + prior, inside.sum() + 1.0, votes[inside].sum(), float(inside.sum())])
                while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                    last = pools.pop()
                    pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.knots, self.values = np.array([p[2] / p[3] for p in pools]), np.array([p[0] / p[1] for p in pools])

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[int, float, int]]]]:
        """Of texts (terms, counts) the probability and the evidence: the five nearest examples' ids, cosines and labels."""
        vectors = [self.unit(t, c) for t, c in rows]
        out: list[tuple[float, list[tuple[int, float, int]]]] = [(self.base, [])] * len(rows)
        known = [i for i, (t, _) in enumerate(vectors) if len(t)] if self.blocks else []
        for i, (vote, at, near) in zip(known, self.votes([vectors[i] for i in known]), strict=True):
            # rounded, as a sum's last digits depend on where it stands
            out[i] = round(float(np.interp(vote, self.knots, self.values)), 9), [(int(self.ids[k]), round(float(c), 6), int(self.labels[k])) for k, c in zip(at[:5], near[:5], strict=True)]
        return out


def examples(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, words, counts) of the labelled rows in the fit: at most `sample` rows and POSTINGS words in all; written."""
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = scratch(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen")
    # a broadcast of at most `sample` rows of two numbers; an id that many rows repeat meets as one row a task
    own = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "label", "words", "counts"])

    counted = scratch(map_text(own.select(F.col("doc_id").cast("long"), "label", "text"), rows, "doc_id long, label int, words array<string>, counts array<int>"), "counted")
    fits, total = [], 0
    for doc, n in counted.select("doc_id", F.size("words")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + n <= POSTINGS:
            fits.append(doc)
            total += n
    return counted.where(F.col("doc_id").isin(fits)) if len(fits) < counted.count() else counted


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Examples:
    """The index of labelled rows; labels: doc_id and label."""
    # words as numbers at once: as many strings as the examples have words would be a lot
    found = examples(documents, labels, sample).orderBy("doc_id").toArrow().combine_chunks()
    words_, counts = (found.column(c).chunk(0) if found.num_rows else pa.array([], pa.list_(t)) for c, t in (("words", pa.string()), ("counts", pa.int32())))
    coded = words_.flatten().dictionary_encode()
    names, codes, counts, cuts = coded.dictionary.to_pylist(), coded.indices.to_numpy(), counts.flatten().to_numpy(), words_.offsets.to_numpy()
    rows = [(i, codes[x:y], counts[x:y], label) for i, label, x, y in zip(found.column("doc_id").to_pylist(), found.column("label").to_pylist(), cuts, cuts[1:], strict=False)]
    number = {w: i for i, w in enumerate(names)}
    held = ship(documents.sparkSession, number)  # of at most POSTINGS words

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held()
        n, total = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for text in texts(batch):
                n[list({c for w in words(text) if (c := known.get(w)) is not None})] += 1
            total += batch.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], ["term", "n"])

    found = map_text(documents.select("text"), frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    of = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True))
    idf = np.array([math.log((1 + of.get(-1, 0)) / (1 + of.get(i, 0))) for i in range(len(names))])
    return Examples(idf, rows, names)


def scored(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and evidence (doc_id, cosine, label of the nearest) of every row; labels: doc_id and label."""
    held = ship(documents.sparkSession, fit(documents, labels, sample))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held()
        for batch in batches:
            out = index.scores([np.unique(np.array([c for w in words(text) if (c := index.number.get(w)) is not None], np.int64), return_counts=True) for text in texts(batch)])
            evidence = [[{"doc_id": a, "cosine": b, "label": c} for a, b, c in e] for _, e in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])))], ["doc_id", "score", "evidence"])

    return map_text(documents.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")
