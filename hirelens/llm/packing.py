"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

A document is its byte-BPE tokens and an end token. Whole stretches of a sequence's length are sequences of their own; what is
left is cut into pieces of at most ``PIECE`` tokens, and each task packs its pieces in groups of some ``GROUP`` tokens, as they come:

* a partial partition lists the fills of up to k windows. The two partitions with the widest spread (fullest minus emptiest window) are merged,
  the fullest windows of one onto the emptiest of the other, until one is left: near-equal windows;
* k starts at the least number that could hold the group and rises by one whenever a window exceeds the capacity;
* a sequence whose length is a power of two needs no padding, so the group's rest over whole windows is first dealt, up to
  three powers of two, into short sequences, which leaves the windows nearly full.

No row is shuffled: a group lies in one task, a task's last group may be smaller. Sequence ids are unique, not gapless.

* Null and empty texts are the end token alone. Repeated rows and null ids are packed each; an empty table gives an empty result.
* Whole texts of any length are packed; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches
from .token_spans import VOCABULARY, Encoder, encoder

CAPACITY, END_TOKEN = 1024, 0
#: Longest piece of a document's rest, and tokens packed together.
PIECE, GROUP = 256, 131_072
#: Powers of two that a group's rest may become.
SHORT = 3
#: Of a group's pieces one for so many windows is halved down to single tokens: small differences that level the windows.
FINE = 3
#: Characters encoded at once, and words whose tokens a worker keeps.
CHARS, HELD_WORDS = 1_000_000, 400_000
#: Pieces handed over at once.
ROWS = 4096


class WordEncoder:
    """Tokens (little-endian unsigned 32-bit) of texts. Before a single blank after a word a token always ends, so the words of a text are
    encoded apart, the new ones of many texts at once, and kept; texts with other white space before a blank are encoded whole."""

    def __init__(self, enc: Encoder):
        self.enc, self.held = enc, {}

    def raw(self, text: str) -> bytes:
        return self.enc.encode(text).astype("<u4").tobytes() if text else b""

    def learn(self, new: list[str]) -> None:
        """Keep the tokens of words, each with the blank before it. Empty words and those with white space at their end are never kept."""
        new = [w for w in new if w and not w[-1].isspace()]
        if not new:
            return
        if len(self.held) + len(new) > HELD_WORDS:
            self.held.clear()
        ids = self.enc.encode(" " + " ".join(new))
        ends = np.cumsum([len(w.encode("utf-8")) + 1 for w in new])
        cut = np.searchsorted(np.cumsum(self.enc.lengths[ids]), ends, "right") * 4
        whole = ids.astype("<u4").tobytes()
        self.held.update(zip(new, map(whole.__getitem__, map(slice, [0, *cut.tolist()], cut.tolist()))))

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [t.split(" ") for t in texts]
        distinct = set().union(*words)
        new = [w for w in distinct if w not in self.held]
        if len(self.held) + len(new) > HELD_WORDS:
            new = list(distinct)  # what is kept is let go
        self.learn(new)
        out = []
        for t, own in zip(texts, words):
            try:
                out.append(b"".join([self.raw(own[0]), *map(self.held.__getitem__, own[1:])]))
            except KeyError:
                out.append(self.raw(t))
        return out


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: the window (0 to k - 1) of each item, and the fullest window's fill."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    # a window is a chain of items: its first item names it
    after, last = np.full(n, -1), np.arange(n)
    # merging single items of falling size lines up the k largest ones first: their spread stays the widest
    top = order[:k]
    number = counter()
    heap = []

    def push(fills: np.ndarray, heads: np.ndarray) -> None:
        spread = int(fills[0]) - (int(fills[-1]) if len(fills) == k else 0)
        heapq.heappush(heap, (-spread, next(number), fills, heads))

    push(sizes[top], top)
    for i in order[k:].tolist():
        push(sizes[i:i + 1], np.array([i]))
    while len(heap) > 1:
        _, _, f, a = heapq.heappop(heap)
        _, _, g, b = heapq.heappop(heap)
        alone_a, alone_b = max(k - len(g), 0), max(k - len(f), 0)
        alone_a, alone_b = min(alone_a, len(f)), min(alone_b, len(g))
        low, other = a[alone_a:], b[alone_b:][::-1]  # a's emptiest windows take b's fullest of those that must share
        if len(low):
            after[last[low]] = other
            last[low] = last[other]
        fills = np.concatenate([f[:alone_a], f[alone_a:] + g[alone_b:][::-1], g[:alone_b]])
        heads = np.concatenate([a[:alone_a], low, b[:alone_b]])
        by = np.argsort(-fills, kind="stable")
        push(fills[by], heads[by])
    _, _, fills, heads = heap[0]
    window = np.empty(n, np.int64)
    at, w = heads.copy(), np.arange(len(heads))
    while len(at):
        window[at] = w
        at = after[at]
        w, at = w[at >= 0], at[at >= 0]
    return window, int(fills[0])


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each item, no window over the capacity; items are at most that large."""
    k = max(-(-int(sizes.sum()) // capacity), 1)
    while True:
        window, fill = difference(sizes, k)
        if fill <= capacity:
            return window
        k += 1


def short_lengths(total: int, capacity: int) -> list[int]:
    """Powers of two to take off a group so that the rest fills whole windows, but for a token or so in two windows."""
    windows, rest = divmod(total, capacity)
    if not windows:
        return [1 << b for b in range(total.bit_length()) if total >> b & 1][::-1]
    rest += windows // 2 + 2 if rest or windows > 1 else 0
    if rest >= capacity:
        return []
    parts: list[int] = []
    while rest > 0 and len(parts) < SHORT:
        b = 1 << (rest.bit_length() - 1)
        if len(parts) == SHORT - 1 and b < rest:
            b *= 2
        parts.append(b)
        rest -= b
    return parts


#: One piece: document's number in its task, start, length.
Piece = tuple[int, int, int]


def padded_length(tokens: int, capacity: int) -> int:
    return tokens if tokens & (tokens - 1) == 0 else capacity


def halved(pieces: list[Piece], n: int) -> list[Piece]:
    """The pieces, the n longest cut into a half, a quarter, and so on."""
    longest = set(sorted(range(len(pieces)), key=lambda i: -pieces[i][2])[:n])
    out = []
    for i, (doc, start, length) in enumerate(pieces):
        while i in longest and length > 1:
            out.append((doc, start, length - length // 2))
            start, length = start + length - length // 2, length // 2
        out.append((doc, start, length))
    return out


def group_sequences(pieces: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """A group's sequences. Pieces may be cut to fill the short ones."""
    out: list[list[Piece]] = []
    left = pieces[::-1]
    for want in short_lengths(sum(p[2] for p in pieces), capacity):
        own = []
        while want:
            doc, start, length = left.pop()
            take = min(length, want)
            own.append((doc, start, take))
            if take < length:
                left.append((doc, start + take, length - take))
            want -= take
        out.append(own)
    if left:
        left = halved(left[::-1], sum(p[2] for p in left) // capacity // FINE + 1)
        window = pack(np.array([p[2] for p in left], np.int64), capacity)
        order = np.argsort(window, kind="stable")
        cut = np.flatnonzero(np.diff(window[order])) + 1
        out += [[left[i] for i in part.tolist()] for part in np.split(order, cut)]
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document and its place: doc_id, start and length (in its document's tokens), ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset, sequence_tokens, padded_to (its length, if a power of two, else the capacity)."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary + ".tiktoken", "rb") as f, open(vocabulary + ".json", encoding="utf-8") as g:
        held = spark.sparkContext.broadcast((f.read(), g.read()))  # a vocabulary's size, whatever the corpus
    end = np.array([END_TOKEN], "<u4").tobytes()
    longest = min(PIECE, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordEncoder(encoder(*held.value))
        ids = counter(TaskContext.get().partitionId() << 33)
        group: list[Piece] = []
        rests: list[tuple[int | None, bytes, int, int]] = []  # of the group's documents: id, tokens left, where they start, all tokens
        tokens, rows = 0, []

        def emit(sequence: list[Piece]) -> None:
            number, total, at = next(ids), sum(p[2] for p in sequence), 0
            for doc, start, length in sequence:
                name, raw, first, n = rests[doc]
                rows.append((name, first + start, length, raw[4 * start:4 * (start + length)], n, number, at, total, padded_length(total, capacity)))
                at += length

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*rows))
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        def encoded(words: WordEncoder, batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, CHARS):
                for name, raw in zip(names[a:b], words.encode(texts[a:b])):
                    yield name, raw + end

        for batch in batches:
            for doc_id, raw in encoded(words, batch):
                n = len(raw) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, raw[4 * start:4 * (start + capacity)], n, next(ids), 0, capacity, capacity))
                    if len(rows) >= ROWS:
                        yield flushed()
                if whole < n:
                    for start in range(0, n - whole, longest):
                        group.append((len(rests), start, min(longest, n - whole - start)))
                    rests.append((doc_id, raw[4 * whole:], whole, n))
                    tokens += n - whole
                if tokens >= GROUP:
                    for sequence in group_sequences(group, capacity):
                        emit(sequence)
                    group, rests, tokens = [], [], 0
                if len(rows) >= ROWS:
                    yield flushed()
        for sequence in group_sequences(group, capacity) if group else []:
            emit(sequence)
        if rows:
            yield flushed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from their pieces: sequence_id, ids (binary, unpadded), padded_to, docs (ids in order)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))  # a sequence's pieces: its capacity bounds them
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"), F.first("padded_to").alias("padded_to"))
    joined = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p.ids))
    return rows.select("sequence_id", joined.alias("ids"), "padded_to", F.col("p.doc_id").alias("docs"))
