"""Quality classifier: naive Bayes support vectors over n-gram indicators.

The n-grams are of bytes, and of marks that tell for each word whether it repeats the one before. Which of them a
whole text holds is scaled by the classes' log-count ratios and brought to unit length; a linear
hinge-loss model is fitted to that by dual coordinate descent and its margins are made probabilities on labelled rows
that the model was not fitted to. The fit sees at most `sample` labelled rows (those of smallest id hash, a bounded
number at any size); scoring is one pass over the whole table without a shuffle.

Defined cases: null is the empty text, it has no n-grams and gets the score of a zero vector; rows without a label,
or of labels without documents, take no part in the fit; with labels of one class only, every score is that class's
share; rows that repeat a doc_id are scored by their own text, and the smallest of their texts is fitted to; texts of
any length are scored whole; ties cannot be; an empty table gives no rows and, fitted to, the score 0.5; extra columns
are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_text, ship, texts

#: log2 of the hashed n-grams; lengths of n-grams in bytes.
BITS, WIDTHS = 16, (2, 3, 4)
#: Marks to an n-gram.
MARKS = 6
#: Labelled rows in the fit, share of them that calibrates, smoothing, cost and rounds of the descent.
SAMPLE, CALIBRATE, ALPHA, COST, ROUNDS = 6000, 0.25, 1.0, 1.0, 30


def grams(text: str, seen: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of a text; seen: a work array of 2**BITS positions."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    parts = []
    for width in WIDTHS:
        n = len(b) - width + 1
        if n > 0:
            h = np.full(n, width, np.uint32)
            for i in range(width):
                h *= np.uint32(0x01000193)
                h ^= b[i : i + n]
            h *= np.uint32(0x9E3779B1)
            parts.append(h >> np.uint32(32 - BITS))
    words = text.split()
    same = np.fromiter(map(str.__eq__, words[1:], words), np.uint32, max(len(words) - 1, 0))
    n = len(same) - MARKS + 1
    if n > 0:
        h = np.ones(n, np.uint32)
        for i in range(MARKS):
            h = h * np.uint32(2) + same[i : i + n]
        parts.append(h)  # below 2 ** (MARKS + 1)
    if not parts:
        return np.empty(0, np.int64)
    h = np.concatenate(parts).astype(np.int64)
    place = np.arange(len(h))
    seen[h] = place
    return h[seen[h] == place]


class Model:
    """Weights r*w by n-gram, squared ratios for the length, bias and calibration; 1 MB at any input size."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.weight, self.square = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias, self.slope, self.offset = 0.0, 0.0, 0.0
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        self.offset = float(np.log(share / (1 - share)))
        if 0 < labels.sum() < len(labels):
            fitted = np.arange(len(rows)) >= CALIBRATE * len(rows)
            if not 0 < labels[fitted].sum() < fitted.sum() or not 0 < labels[~fitted].sum():
                fitted[:] = True
            self._fit([r for r, ok in zip(rows, fitted, strict=True) if ok], labels[fitted])
            held = ~fitted if not fitted.all() else fitted
            self._calibrate(np.array([self.margin(r) for r, ok in zip(rows, held, strict=True) if ok]), labels[held])

    def _fit(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        counts = np.full((2, 1 << BITS), ALPHA)
        for r, y in zip(rows, labels, strict=True):
            counts[int(y)][r] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        self.square = ratio**2
        y = np.where(labels > 0, 1.0, -1.0)
        scale = [1 / np.sqrt(max(self.square[r].sum(), 1e-12)) for r in rows]
        # dual coordinate descent for the hinge loss; the bias is the weight of a constant 1
        w, bias, dual, order = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
        for _ in range(ROUNDS):
            most = 0.0
            for i in order.permutation(len(rows)):
                r = rows[i]
                gradient = y[i] * (scale[i] * (w[r] @ ratio[r]) + bias) - 1
                new = min(max(dual[i] - gradient / (2.0 if len(r) else 1.0), 0.0), COST)
                step = (new - dual[i]) * y[i]
                if step:
                    w[r] += step * scale[i] * ratio[r]
                    bias += step
                    dual[i] = new
                    most = max(most, abs(step))
            if most < 1e-3:
                break
        self.weight, self.bias = w * ratio, bias

    def margin(self, r: np.ndarray) -> float:
        return float(self.weight[r].sum() / np.sqrt(max(self.square[r].sum(), 1e-12)) + self.bias) if len(r) else float(self.bias)

    def _calibrate(self, margins: np.ndarray, labels: np.ndarray) -> None:
        """Platt's sigmoid with smoothed targets, by Newton steps."""
        n1 = labels.sum()
        target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * margins + b)))
            v = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
            h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2 / max(np.abs(step).max(), 1e-12))
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = float(max(a, 0.0)), float(b)

    def score(self, r: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.margin(r) + self.offset))))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id and label (0 or 1). Equal labels of an id count once, of different ones the largest counts."""
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers; an id that many rows repeat meets as one row a task
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([grams(t, seen).astype(np.uint16).tobytes() for t in texts(batch)], pa.binary())], ["doc_id", "label", "grams"])

    got = map_text(rows.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text"), features, "doc_id long, label int, grams binary").collect()
    # by a hash: which rows calibrate has nothing to do with the order of ids
    got = sorted(got, key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % 2**64, r["grams"]))
    return Model([np.frombuffer(r["grams"], np.uint16) for r in got], np.array([float(r["label"]) for r in got]))


def scored(documents: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns of documents asked for and, under `name`, the probability of label 1."""
    held = ship(documents.sparkSession, model)
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, fitted = np.zeros(1 << BITS, np.int64), held()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array([fitted.score(grams(t, seen)) for t in texts(batch)], pa.float64())], [*columns, name])

    return map_text(documents.select(*dict.fromkeys([*columns, "text"])), rows, f"{schema}, `{name}` double")


def split(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the rows that a model may learn from."""
    return labels.where(fold("doc_id", modulus) != held_out).select("doc_id", F.col(label).alias("label"))
