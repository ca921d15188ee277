import random

import numpy as np
import pytest
import xxhash

from hirelens.llm import simhash_pigeonhole as S
from hirelens.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(ids, fps, bits=2):
    """ids must not be null."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta\t", "été", "Zeta x", "nu", "xi"]) + str(rng.randrange(40)) for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    base = [words(rng, rng.choice([0, 1, 2, 3, 4, 30, 400])) for _ in range(60)]
    texts = base + [None, "", "   \n"] + base[:15]
    for t in base[20:]:  # near copies: a word changed here and there
        for _ in range(3):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i * 3 + 1, t, "en", None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components([i * 3 + 1 for i in range(len(texts))], fps)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i * 3 + 1].fingerprint == f"{fps[i]:016x}"
        assert got[i * 3 + 1].component_id == want[i]
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


@pytest.mark.parametrize("dense", [False, True])
def test_links_lose_no_pair(spark, monkeypatch, dense):
    """Chains and clouds of fingerprints 1 to 3 bits apart, by probes and by variants."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(40):
        f = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 12))):
            fps.add(f)
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                f ^= 1 << int(b)
    fps = sorted(fps)
    if dense:
        monkeypatch.setattr(S, "VARIANTS", 4)  # so that most take the whole width
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in S.group(df).collect()}
    want = plain_components(list(range(len(fps))), fps)
    assert [got[int(np.uint64(f).astype(np.int64))] for f in fps] == want


def test_threshold_vectors_spend_all_units():
    hist = np.random.default_rng(0).integers(0, 50, (4, 1 << 16))
    keys = np.random.default_rng(1).integers(0, 1 << 16, (100, 4))
    vector, cost = S.allocate(keys, S.candidate_counts(hist))
    assert ((vector.astype(int) + 1).sum(axis=1) == 3).all() and (vector >= -1).all()
    every = [v for v in np.ndindex(4, 4, 4, 4) if sum(v) == 3]
    counts = S.candidate_counts(hist)
    for k in range(20):
        best = min(sum(counts[i, u - 1][keys[k, i]] + S.PROBE_COST * len(S.ball(u - 1)) for i, u in enumerate(v) if u) for v in every)
        assert abs(best - cost[k]) < 1e-6


def test_null_ids_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two three four", None, None, None), (7, "one two three four", "en", "s", 1),
                                  (7, "one two three four", "en", "s", 1), (None, "alone here", None, None, None)], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_duplicates(docs).collect() if r.component_id is not None)
    assert got == [(-1, 7), (7, 7), (7, 7)]
    assert sorted(r.text for r in S.deduplicate(docs).collect()) == ["alone here", "one two three four"]
    empty = docs.limit(0)
    assert S.near_duplicates(empty).count() == 0 and S.deduplicate(empty).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8)], "doc_id long, text string, fingerprint int, component_id int")
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns and [r.fingerprint for r in kept.collect()] == [5]


def test_components_of_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([((i * 7919) % 1009, ((i + 1) * 7919) % 1009) for i in range(n)], "a long, b long")
    got = components(edges).collect()
    assert len(got) == n + 1 and {r.root for r in got} == {min((i * 7919) % 1009 for i in range(n + 1))}
