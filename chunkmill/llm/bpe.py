"""BPE encoding and decoding with a given byte-level vocabulary (never trained here).

Words new to a partition are encoded together: an index maps each adjacent pair that has a merge rank to all its
positions, the ranks that occur are applied in ascending order, and every merge updates the lists of the pairs it
makes. A merge makes a new symbol, so the pairs it makes always rank higher: one pass over the ranks is exact.

Defined cases: null is the empty text and has no ids; strings of special tokens in a text become their one id, as
the vocabulary's own library does; any length is encoded whole; rows that repeat a doc_id or have none are rows like
others; of equal pairs the first in a word merges first; an empty table gives no rows; extra columns are passed over,
whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_text, texts

#: The byte-level pre-tokenizer's pattern, white space spelled out as Unicode's property has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words whose ids a task remembers, and bytes of text that are encoded together: whole texts, cut where they reach this.
REMEMBERED, TOGETHER = 400_000, 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file's content."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.width = max(vocab.values()) + 1
        self.by_rank = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        codes = np.array([a * self.width + b for a, b, _ in self.by_rank], np.int64)
        self.rank = np.argsort(codes, kind="stable")
        self.codes = codes[self.rank]
        bytes_of = {i: bytes(value[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        bytes_of.update({i: t.encode() for t, i in self.special.items()})
        self.tokens = pa.array(map(bytes_of.get, range(max(bytes_of) + 1)), pa.large_binary())
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.ids: dict[str, bytes] = {}

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word's after another's, and how many each word has."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol, n = self.first[raw], len(raw)
        word_of = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        edge = np.flatnonzero(word_of[1:] != word_of[:-1])
        after[edge], before[edge + 1] = -1, -1
        if n:
            after[-1] = -1
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enters the pairs that begin at these positions under their ranks."""
            code = symbol[at] * self.width + symbol[after[at]]
            place = np.searchsorted(self.codes, code)
            place[place == len(self.codes)] = 0
            found = self.codes[place] == code
            at, rank = at[found], self.rank[place[found]]
            if not len(at):
                return
            order = np.lexsort((at, rank))
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, own in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r in where:
                    where[r].append(own)
                else:
                    where[r] = [own]
                    heapq.heappush(active, r)

        note(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            a, b, new = self.by_rank[r]
            lists = where.pop(r)
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            i = i[(symbol[i] == a) & (after[i] >= 0)]
            i = i[symbol[after[i]] == b]
            if a == b and len(i) > 1:  # of overlapping pairs the left one goes first
                kept, taken = [], -1
                for x, y in zip(i.tolist(), after[i].tolist(), strict=True):
                    if x != taken:
                        kept.append(x)
                        taken = y
                i = np.array(kept, np.int64)
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            symbol[i], symbol[j] = new, -1
            after[i], after[j] = k, -1
            more = k >= 0
            before[k[more]] = i[more]
            left = before[i]
            left = left[left >= 0]
            note(np.unique(np.concatenate([left, i[more]])) if len(left) + more.sum() > 1 else np.concatenate([left, i[more]]))
        alive = symbol >= 0
        return symbol[alive], np.bincount(word_of[alive], minlength=len(words))

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        new = [w for w in words if w not in self.ids and w not in self.special]
        ids, counts = self.merged([w.encode() for w in new])
        ends = np.cumsum(counts).tolist()
        raw = ids.astype("<u4").tobytes()
        for word, n, end in zip(new, counts.tolist(), ends, strict=True):
            self.ids[word] = raw[4 * (end - n) : 4 * end]
        for token in words & self.special.keys():
            self.ids[token] = np.array([self.special[token]], "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.split(text)
        return [x for part in self.cut.split(text) for x in ([part] if part in self.special else self.split(part))]

    def decode_bytes(self, ids: list[int] | np.ndarray) -> bytes:
        found = self.tokens.take(pa.array(ids, pa.uint32()))
        if found.null_count:
            raise KeyError("an id without a token")
        _, ends, data = found.buffers()
        return data[: np.frombuffer(ends, np.int64)[len(found)]].to_pybytes() if len(found) else b""

    def encode_batch(self, rows: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        parts = [self.pieces(t) for t in rows]
        self.learn(set().union(*parts))
        for words in parts:
            ids = b"".join(map(self.ids.__getitem__, words))
            yield ids, self.decode_bytes(np.frombuffer(ids, "<u4"))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text]))[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def encoded(documents: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and the ids themselves if asked for.

    vocabulary: path of the tokenizer's JSON file on the driver; its content (1.3 MB for 50,257 ids, it does not
    grow with the input) goes to the executors as a broadcast.
    """
    with open(vocabulary, "rb") as f:
        content = documents.sparkSession.sparkContext.broadcast(f.read())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(content.value)

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for ids, decoded in codec.encode_batch([t for own in held for t in texts(own)]):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.concat_arrays([own.column("doc_id") for own in held]), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), *([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else [])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

        held, size = [], 0
        for batch in batches:
            at = 0
            for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                size += n or 0
                if size >= TOGETHER:
                    yield done([*held, batch.slice(at, i + 1 - at)])
                    held, size, at = [], 0, i + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield done(held)

    return map_text(documents.select(documents["doc_id"].cast("long"), "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
