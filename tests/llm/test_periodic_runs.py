import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hirelens.llm import periodic_runs
from hirelens.llm.queries import QUERIES, looped_words

SF = "/root/testdata/sf0.01"


def brute(words):
    """Every maximal stretch of every period, from the definition; the smallest period of each."""
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w[q:] == w[:-q]).astype(np.int8), [0]])))
        for i, j in edge.reshape(-1, 2).tolist():
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def found(texts):
    number = {}
    ids = [[number.setdefault(w, len(number) + 1) for w in t] for t in texts]
    got = periodic_runs.find(np.array([k for t in ids for k in t], np.int64), np.array([len(t) for t in texts], np.int64))
    return [[tuple(map(int, r[1:])) for r in got if r[0] == k] for k in range(len(texts))]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_find_against_definition(letters):
    rng = random.Random(letters)
    texts = [[rng.randrange(letters) for _ in range(rng.randrange(60))] for _ in range(300)]
    for _ in range(300):
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
        body = (unit * 9)[:rng.randrange(4, 50)]
        texts.append([rng.randrange(letters) for _ in range(rng.randrange(6))] + body + [rng.randrange(letters) for _ in range(rng.randrange(6))] + body[:rng.randrange(20)])
    assert found(texts) == [brute(t) for t in texts]


def test_wide_vocabulary_and_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    rng = random.Random(9)
    texts = [list(b)] + [[rng.randrange(1 << 40) for _ in range(20)] * k + [1] for k in (1, 3, 4, 5)] * 30
    assert found(texts) == [brute(t) for t in texts]


def test_same_line_many_times_in_one_text():
    rng = random.Random(2)
    line = [f"l{k}" for k in range(12)]
    text = [w for _ in range(3000) for w in line + [str(rng.randrange(10 ** 6)) for _ in range(9)]]
    assert found([text + line * 4]) == [[(len(text), 48, 12)]]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in docs.collect())
    assert sum(g[1] for g in got) > 100


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "x x x x x x x y"), (4, "x\x1cx " * 6), (4, "x\x1cx " * 6), (5, "a b " * 50_000), (6, "z " * 40_000), (7, "é e é " * 4), (10, "one two three " * 30)]
    df = spark.createDataFrame([(i, t, 3, "q") for i, t in rows], "doc_id long, text string, n_runs int, runs string")
    got = [tuple(r) for r in periodic_runs.digests(periodic_runs.detect(df, looped_words)).collect()]
    small = [r for r in rows if r[0] not in (5, 6)]
    assert sorted((g for g in got if g[0] not in (5, 6)), key=str) == sorted((expected(*r) for r in small), key=str)
    assert {g[0]: g[1:6] for g in got if g[0] in (5, 6)} == {5: (1, 0, 100_000, 2, 50_000_000), 6: (1, 0, 40_000, 1, 40_000_000)}
    assert periodic_runs.digests(periodic_runs.detect(df.limit(0))).count() == 0
