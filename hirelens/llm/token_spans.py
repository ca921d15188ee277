"""Token counts attributed to sections through offsets.

A whole document is encoded once with a byte-level BPE vocabulary. Tokens concatenate to the
text's bytes, so their byte lengths give each token's span, mapped to code points. The token spans
are interval-joined with the document's sections (character spans, gaps allowed). Where sections overlap, the one that
starts first (then: ends first) keeps the characters and the later one begins after it; one that ends before it starts is empty.
A token across a boundary is allocated by a rule:

* ``start``: to the section that holds its first character;
* ``most``: to the section it shares most characters with, the earlier one of equals;
* ``share``: to each section, the share of its characters that lies there.

Tokens that meet no section are counted under section null. A token of part of a character covers that character.

* Null and empty texts have no tokens; their sections get 0. A document without sections has one row, section null.
* Repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k"
#: How the vocabulary's authors split text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("start", "most", "share")


class Encoder:
    """Token ids and byte lengths. ``ranks`` and ``json`` hold one vocabulary for two libraries: the
    second takes the rare texts (runs of many thousand blanks) on which the first one's pattern gives up."""

    def __init__(self, ranks: bytes, json: str):
        pairs = [line.split() for line in ranks.splitlines() if line]
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.json, self.slow = json, None
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:
            if self.slow is None:
                self.slow = Tokenizer.from_str(self.json)
                self.slow.encode_special_tokens = True  # their names in a text are ordinary text
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code point starts and ends of the text's tokens."""
        ends = np.cumsum(self.lengths[self.encode(text)]) if text else np.zeros(0, np.int64)
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        if len(ends) == 0 or ends[-1] != len(raw):
            if text:
                raise ValueError("tokens don't concatenate to the text")
            return ends, ends
        starts = np.concatenate([[0], ends[:-1]])
        if len(raw) == len(text):
            return starts, ends
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        return char[starts], char[ends - 1] + 1


@lru_cache(4)
def encoder(ranks: bytes, json: str) -> Encoder:
    return Encoder(ranks, json)


def attribute(start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens [start, end) and sections [a, b) -> tokens and boundary-crossing tokens of
    each section, and tokens outside all. Both sides sorted."""
    n = len(a)
    first = np.searchsorted(b, start, "right")  # the first section that ends after the token's start
    last = np.searchsorted(a, end, "left") - 1  # the last that begins before its end
    meets = last >= first
    inside = meets & (first == last)
    inside[inside] = (a[first[inside]] <= start[inside]) & (end[inside] <= b[first[inside]])
    counts = np.bincount(first[inside], minlength=n).astype(float)
    crossing, outside = np.zeros(n), float((~meets).sum())
    for t in np.flatnonzero(meets & ~inside):
        s, e = int(start[t]), int(end[t])
        over = [(min(e, int(b[k])) - max(s, int(a[k])), k) for k in range(first[t], last[t] + 1)]
        for _, k in over:
            crossing[k] += 1
        if rule == "share":
            for o, k in over:
                counts[k] += o / (e - s)
            outside += 1 - sum(o for o, _ in over) / (e - s)
        elif rule == "most":
            counts[max(over, key=lambda x: (x[0], -x[1]))[1]] += 1
        elif a[first[t]] <= s:
            counts[first[t]] += 1
        else:
            outside += 1
    return counts, crossing.astype(np.int64), outside


def disjoint(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections sorted by start and end, each cut to begin where all before it have ended."""
    before = np.concatenate([[0], np.maximum.accumulate(np.maximum(b, 0))[:-1]]) if len(a) else a
    a = np.maximum(a, before)
    return a, np.maximum(a, b)


def with_sections(docs: DataFrame, sections: DataFrame, name: str = "sections") -> DataFrame:
    """``docs`` with the sections (doc_id, name, start, end) of each document in one array column ``name``."""
    own = sections.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("name", "start", "end")).alias(name))
    return docs.drop(name).join(own, F.col("doc_id") == F.col("__id"), "left").drop("__id")


def count(docs: DataFrame, rule: str = "most", vocabulary: str = VOCABULARY, sections: str | None = None) -> DataFrame:
    """Tokens of every section of every document: doc_id, section (number from 0, null: outside all), name, start, end,
    n_tokens (by the rule), n_crossing, doc_tokens. ``docs`` has doc_id, text and, if its sections aren't
    its lines, an array column of (name, start, end), named by ``sections``; other columns don't matter."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary + ".tiktoken", "rb") as f, open(vocabulary + ".json", encoding="utf-8") as g:
        held = spark.sparkContext.broadcast((f.read(), g.read()))  # a vocabulary's size, whatever the corpus
    by_lines = sections is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*held.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            given = [None] * len(ids) if by_lines else batch.column(2).to_pylist()
            cols: list[list] = [[] for _ in range(8)]

            def add(*parts):
                for c, p in zip(cols, parts):
                    c.append(p)

            for doc, text, marked in zip(ids, texts, given):
                start, end = enc.spans(text)
                if by_lines:
                    ends = np.cumsum([len(x) for x in text.split("\n")], dtype=np.int64) + np.arange(1, text.count("\n") + 2)
                    ends[-1] -= 1  # no line break after the last
                    a, b = np.concatenate([[0], ends[:-1]]), ends
                    a, b = a[b > a], b[b > a]
                    names = [f"line {k + 1}" for k in range(len(a))]
                else:
                    own = sorted((s for s in marked or [] if s["start"] is not None and s["end"] is not None), key=lambda s: (s["start"], s["end"]))
                    a, b = (np.array([s[k] for s in own], np.int64) for k in ("start", "end"))
                    names = [s["name"] for s in own]
                    a, b = disjoint(a, b)
                held_some = b > a
                n, crossing = np.zeros(len(a)), np.zeros(len(a), np.int64)
                n[held_some], crossing[held_some], outside = attribute(start, end, a[held_some], b[held_some], rule)
                for k in range(len(a)):
                    add(doc, k, names[k], int(a[k]), int(b[k]), float(n[k]), int(crossing[k]), len(start))
                if outside > 1e-9 or not len(a):
                    add(doc, None, None, None, None, outside, 0, len(start))
            types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if by_lines else [sections]))
    return rows.mapInArrow(run, "doc_id long, section int, name string, start long, end long, n_tokens double, n_crossing long, doc_tokens long")
