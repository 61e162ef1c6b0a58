"""Secret scans: fixed rules, and character Markov models of random strings and ordinary identifiers.

Labelled samples teach the models: random strings of four alphabets, identifiers put together from common words in the
usual styles, numbers and hexadecimal names (parts of UUIDs, short digests), and the words of all documents outside the
rules' finds. Each kind has a model of its transitions; a class's likelihood is the mixture of its kinds'. Every token is
judged, and added to the rules' finds when its log-likelihood ratio, in all and for each character, favours random
strings. Short hexadecimal strings are names and never added; the rules find the long ones.

Defined cases: null is the empty text; offsets are code points, ends exclusive; finds of a kind do not overlap; added
spans never overlap a rule's; of finds that begin together the kinds' order decides; texts of any length are scanned
whole; rows that repeat a doc_id are scanned each by itself; an empty table gives no rows; extra columns are passed over,
whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, ship, texts

#: The base rules.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters and more: a shorter run has no longer match inside
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
#: Fixed value: the characters of tokens; all others end one.
LETTERS = string.ascii_letters + string.digits + "+/_="
TOKEN = re.compile(r"[A-Za-z0-9+/_=]{10,}")
STATES = len(LETTERS) + 1
#: Log-likelihood ratio asked for, in nats: of a token and of each of its characters. Samples of each kind.
LEAST, LEAST_EACH, SAMPLES = 10.0, 0.4, 3000
#: Alphabets of random strings.
ALPHABETS = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base36": string.ascii_lowercase + string.digits, "base32": string.ascii_uppercase + "234567"}
#: Common words of identifiers.
COMMON = (
    "account action active add address admin all api app array async auth back base batch begin bool buffer build button by cache call card "
    "category change char check child class clear client close code color column config connection content context control copy count create "
    "current data database date day default delete description device dir document domain download edit email enable end engine entry error "
    "event exception export factory field file filter find first flag float font form format from function get global group handler hash "
    "header height hidden host icon id image import index info init input int item job json key label language last layer layout left length "
    "level library limit line link list load local location lock log login manager map master max member menu message method min mode model "
    "module month name network new node note null number object offset old on open option order output owner package page panel param parent "
    "parse password path pattern payment pool port position post prefix price print private process product profile project property public "
    "query queue random range rate read record ref remove render report request reset resource response result right role root row rule run "
    "save schema score search select send server service session set settings shape show size source space start state status step stop "
    "store stream string style sub sum system tab table tag target task template test text thread time title token tool total trace tree type "
    "unit update upload url user util valid value var vector version view visible web widget width window with word worker write zone"
).split()

Span = tuple[int, int, int]
_CLASS = np.zeros(0x110000 // 0x100, np.uint8)
_CLASS[[ord(c) for c in LETTERS]] = np.arange(1, STATES)


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the rules' finds by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= 8] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def transitions(text: str) -> np.ndarray:
    """Counts of adjacent states (0: between tokens), STATES * STATES of them."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    states = np.zeros(len(b) + 2, np.uint16)
    states[1:-1] = _CLASS[b]
    return np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)


def samples(seed: int = 0) -> Iterator[tuple[str, str]]:
    """(kind, string): the labelled samples that are made, the same at every run; kinds of ALPHABETS are random strings."""
    draw = random.Random(seed)
    for kind, letters in ALPHABETS.items():
        for _ in range(SAMPLES):
            yield kind, "".join(draw.choices(letters, k=draw.randint(10, 44)))
    for _ in range(4 * SAMPLES):
        words = [draw.choice(COMMON) if draw.random() < 0.9 else str(draw.choice((draw.randrange(10), draw.randrange(100), 2 ** draw.randrange(17), 1970 + draw.randrange(80)))) for _ in range(draw.randint(1, 6))]
        style = draw.randrange(6)
        name = ("_".join(words), "_".join(words).upper(), words[0] + "".join(map(str.capitalize, words[1:])), "".join(map(str.capitalize, words)), "/".join(words), "".join(words))[style]
        if draw.random() < 0.2:
            name += draw.choice(("_v", "v", "_", "", "x")) + str(draw.randrange(30)) + draw.choice(("", "", "x", "px", "ms"))
        yield "identifier", name
    for _ in range(2 * SAMPLES):
        yield "number", "".join(draw.choices(draw.choice((string.digits, "0123456789abcdef", "0123456789ABCDEF")), k=draw.choice((4, 6, 7, 8, 10, 12, 14, 16, 20, 24))))


class Models:
    """Log-probabilities of transitions by kind, and each kind's share of its class."""

    def __init__(self, prose: np.ndarray, made: Iterator[tuple[str, str]]):
        counts: dict[str, np.ndarray] = {"prose": prose}
        for kind, text in made:
            counts[kind] = counts.get(kind, 0) + transitions(text)
        self.of: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for kind, n in counts.items():
            n = n.reshape(STATES, STATES) + 0.5
            self.of[kind in ALPHABETS].append(np.log(n / n.sum(1, keepdims=True)))

    def ratios(self, tokens: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each token, random strings against ordinary ones."""
        if not tokens:
            return np.empty(0)
        states = _CLASS[np.frombuffer(("\n" + "\n".join(tokens)).encode(), np.uint8)].astype(np.int64)
        starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in tokens])[:-1]))
        pairs = states[:-1] * STATES + states[1:]
        pairs[starts[1:] - 1] = -1  # from a token's end to the mark after it

        def likelihood(models: list[np.ndarray]) -> np.ndarray:
            return np.logaddexp.reduce([np.add.reduceat(np.where(pairs < 0, 0.0, m.ravel()[pairs]), starts) for m in models]) - np.log(len(models))

        # rounded, as a sum's last digits depend on where it stands
        return np.round(likelihood(self.of[True]) - likelihood(self.of[False]), 6)


def train(documents: DataFrame) -> Models:
    """The models, with the words of all documents as ordinary ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            for text in texts(batch):
                total += transitions(text)
                base = base_spans(text)
                for a, b in [(a, b) for a, _, b in base] + candidates(text, base):  # what is still to be judged teaches nothing
                    total -= transitions(text[a:b])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    prose = np.zeros(STATES * STATES)
    for pair, n in map_text(documents.select("text"), rows, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most STATES ** 2 rows
        prose[pair] = max(n, 0)
    return Models(prose, samples())


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Tokens that touch no rule's find."""
    found = [m.span() for m in TOKEN.finditer(text)]
    return [(a, b) for a, b in found if not any(x < b and a < y for x, _, y in base)] if base else found


def random_ones(texts_: list[str], bases: list[list[Span]], models: Models) -> list[list[Span]]:
    """Of each text the candidates that look random."""
    spans = [candidates(t, b) for t, b in zip(texts_, bases, strict=True)]
    ratios = iter(models.ratios([t[a:b] for t, own in zip(texts_, spans, strict=True) for a, b in own]).tolist())
    return [[(a, 3, b) for (a, b), r in zip(own, ratios) if r >= LEAST and r >= LEAST_EACH * (b - a)] for own in spans]  # noqa: B905


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id, finds by rule, sha256 of the rules' spans and all spans of every row."""
    held = ship(documents.sparkSession, train(documents))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held()
        for batch in batches:
            own = texts(batch)
            base = [base_spans(t) for t in own]
            every = [sorted(b + more) for b, more in zip(base, random_ones(own, base, models), strict=True)]
            counts = [pa.array([sum(x[1] == k for x in b) for b in base], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(said(b).encode()).hexdigest() for b in base], pa.string()), pa.array([said(x) for x in every], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_text(documents.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
