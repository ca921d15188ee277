"""Periodic runs of words by maximal pairs.

A run is a stretch of consecutive words with smallest period q, at least max(least, 4 q) words long, that no neighbouring
word extends keeping period q. Two places i < j with a common stretch of l words that neither the words before nor the words after
them extend are a maximal pair; if j - i = q, the stretch from i to j + l has period q and can't be extended either. So the maximal
pairs with l >= max(least - q, 3 q) are the runs, a run of smallest period p once for every period p, 2 p, ... that fits: the
smallest counts.

Maximal pairs come from the LCP-interval tree over the suffixes of each text, bottom up. Suffixes are sorted by prefix doubling, all
texts of a block side by side (a text's number leads its keys, so none meets another's), where suffixes already told apart take no
further part; the ranks of each round also give the common prefixes. Only intervals of 5 or more words matter: l >= max(6 - q, 3 q) needs them.
Each node keeps its places in text order together with their classes, the words to their left. When a child joins its node, each
place of the smaller side looks for places of the other side within l / 3, and pairs with those of another class. Places of one node that
close lie at multiples of the period of their common stretch, and all but the first of them have the same word to their left: so
a search can stop at the first place of its own class, and costs no more than the pairs it finds.

* Words are the stretches without the six ASCII blanks, by their UTF-8 bytes. Null, empty and blank texts have no words and no runs.
* Repeated rows and null ids stay rows of their own; an empty table gives an empty result; other columns are ignored.
* Whole texts of any length are searched; a text is one row of one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, run_starts, small_batches

#: A run's least words, and how often its period fits at least.
LEAST, TIMES = 6, 4
#: Common stretches shorter than this belong to no run: min over q of max(LEAST - q, (TIMES - 1) q).
COMMON = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST + 1))


def suffix_order(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all texts in order, text by text, and each one's common prefix with the one before it (exact from
    COMMON words on, else 0). ``words``: numbers from 1; ``doc`` and ``end``: the text of each place, and where it ends."""
    n = len(words)
    place = np.arange(n)
    width = max(int(words.max()).bit_length(), 1)
    depth = max(1, min(COMMON, (62 - int(doc[-1]).bit_length()) // width))
    key = doc.astype(np.int64)
    for k in range(depth):
        word = np.zeros(n, np.int64)
        word[:n - k] = words[k:]
        key = (key << width) | np.where(place + k < end, word, 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    lcp = np.zeros(n, np.int64)
    ranks: list[tuple[int, np.ndarray]] = []

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b share, if that is less than twice the last round's depth."""
        a, b, shared = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        steps = [(d, r) for d, r in reversed(ranks)]
        for d, rank in steps:
            inside = (a + d <= end_of(a)) & (b + d <= end_of(b))
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            a, b, shared = a + d * same, b + d * same, shared + d * same
        going = np.ones(len(a), bool)
        for _ in range(max(depth, 1)):
            going &= (a < end_of(a)) & (b < end_of(b))
            going &= words[np.minimum(a, n - 1)] == words[np.minimum(b, n - 1)]
            a, b, shared = a + going, b + going, shared + going
        return shared

    bound = end  # the end of the text that a place (or the place after its last) belongs to

    def end_of(p: np.ndarray) -> np.ndarray:
        """The end of the text of the place before p: p itself once the text is used up."""
        return bound[np.maximum(p - 1, 0)] if len(p) else p

    rank = np.zeros(n, np.int64)
    starts = np.flatnonzero(new)
    group = np.repeat(starts, np.diff(np.append(starts, n)))
    rank[order] = group
    active = np.flatnonzero(np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n))))
    h = depth
    while len(active):
        ranks.append((h, rank.copy()))
        at = order[active]
        own = rank[at]
        after = np.where(at + h < end[at], rank[np.minimum(at + h, n - 1)], -1)
        perm = np.argsort(own * (n + 1) + after + 1, kind="stable")
        at, own, after = at[perm], own[perm], after[perm]
        order[active] = at
        first = np.concatenate([[True], own[1:] != own[:-1]])
        split = np.concatenate([[False], (own[1:] == own[:-1]) & (after[1:] != after[:-1])])
        s = np.flatnonzero(split)
        lcp[active[s]] = h + common(at[s - 1] + h, at[s] + h)
        begins = np.flatnonzero(first | split)
        sizes = np.diff(np.append(begins, len(at)))
        rank[at] = np.repeat(active[begins], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        h *= 2
    lcp[lcp < COMMON] = 0
    return order, lcp


def maximal_pairs(places: list[int], lcps: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """Maximal pairs (i, j, l) with j - i <= l / 3 under one interval: its suffixes in order, the common prefixes between
    them, the word to the left of every place."""
    found: list[tuple[int, int, int]] = []

    def join(a: list[int], b: list[int], l: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        reach = l // (TIMES - 1)
        for i in b:
            c = left[i]
            for k in range(bisect_left(a, i - reach), len(a)):
                j = a[k]
                if j > i + reach or left[j] == c:
                    break
                found.append((i, j, l) if i < j else (j, i, l))
        if len(b) * 16 < len(a):
            for i in b:
                insort(a, i)
        else:
            a = sorted(a + b)  # two runs in order: one merge
        return a

    stack: list[tuple[int, list[int]]] = []
    child = [places[0]]
    for l, p in zip(lcps, places[1:]):
        while stack and stack[-1][0] > l:
            depth, node = stack.pop()
            child = join(node, child, depth)
        if stack and stack[-1][0] == l:
            stack[-1] = (l, join(stack[-1][1], child, l))
        else:
            stack.append((l, child))
        child = [p]
    while stack:
        depth, node = stack.pop()
        child = join(node, child, depth)
    return iter(found)


def find(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs (text, start, length, period), sorted, of texts given as consecutive runs of word numbers from 1."""
    none = np.zeros((0, 4), np.int64)
    n = len(words)
    if n == 0:
        return none
    begin = run_starts(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end = (begin + lengths)[doc]
    order, lcp = suffix_order(words, doc, end)
    if not lcp.any():
        return none
    # blocks: the intervals of COMMON words or more that hang right below the root
    edge = np.diff(np.concatenate([[0], (lcp > 0).astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1) - 1  # slots, both included
    sizes = last - first + 1
    block = np.repeat(np.arange(len(first)), sizes)
    slots = np.repeat(first - run_starts(sizes), sizes) + np.arange(sizes.sum())
    at = order[slots]
    # a block whose places all lie farther apart than its longest common stretch allows has no pair
    by = np.lexsort((at, block))
    near = np.where(block[by][1:] == block[by][:-1], at[by][1:] - at[by][:-1], n)
    gap = np.full(len(first), n)
    np.minimum.at(gap, block[by][1:], near)
    deepest = np.maximum.reduceat(np.where(np.isin(slots, first), 0, lcp[slots]), run_starts(sizes))
    left = np.concatenate([[0], words[:-1]])
    left[begin[lengths > 0]] = 0
    pairs: list[tuple[int, int, int]] = []
    keep = np.flatnonzero(gap * (TIMES - 1) <= deepest)
    if len(keep):
        classes = left.tolist()
        for k in keep:
            pairs.extend(maximal_pairs(order[first[k]:last[k] + 1].tolist(), lcp[first[k] + 1:last[k] + 1].tolist(), classes))
    if not pairs:
        return none
    i, j, l = np.array(pairs, np.int64).T
    q = j - i
    fits = l >= np.maximum(LEAST - q, (TIMES - 1) * q)
    i, q, l = i[fits], q[fits], l[fits]
    order = np.lexsort((q, q + l, i))
    i, q, length = i[order], q[order], (q + l)[order]
    smallest = np.concatenate([[True], (i[1:] != i[:-1]) | (length[1:] != length[:-1])]) if len(i) else np.zeros(0, bool)
    i, q, length = i[smallest], q[smallest], length[smallest]
    own = doc[i]
    start = i - begin[own]
    order = np.lexsort((q, start, own))
    return np.stack([own, start, length, q], axis=1)[order]


def covered(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run (start, length, period) after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) > 0


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def detect(docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's runs by start, then period, and ``collapsed``: its words, joined by a blank, without those that a run repeats (UTF-8).
    ``rewrite`` may first replace the words of a text: for an id and a number of words it gives the place that each word is taken from, or None."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks([t or "" for t in texts]):
                yield block(ids[a:b], texts[a:b])

    def block(ids: list, texts: list) -> pa.RecordBatch:
        number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        words, numbers = [], []
        for i, t in zip(ids, texts):
            own = (t or "").encode("utf-8").split()
            place = rewrite(i, len(own)) if rewrite else None
            if place is not None:
                own = [own[k] for k in place.tolist()]
            words.append(own)
            numbers.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
        lengths = np.array([len(w) for w in words], np.int64)
        runs = find(np.concatenate(numbers), lengths) if len(numbers) else np.zeros((0, 4), np.int64)
        cut = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
        kept = []
        for k, own in enumerate(words):
            mine = runs[cut[k]:cut[k + 1], 1:]
            if len(mine):
                own = [own[m] for m in np.flatnonzero(~covered(len(own), mine)).tolist()]
            kept.append(b" ".join(own))
        fields = pa.StructArray.from_arrays([pa.array(runs[:, m]) for m in (1, 2, 3)], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), fields)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths), lists, pa.array(kept, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """What ``detect`` found, a row a document: n_runs, the longest run (ties: smallest start, then period), digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    rank = F.transform("runs", lambda r: F.struct((-r.length).alias("order"), r.start.alias("start"), r.period.alias("period")))
    best = F.array_min(rank)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.order")
    return rows.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
                       F.expr("1000 * -best.order div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
