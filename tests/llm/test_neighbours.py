import numpy as np
import pytest

from hirelens.llm import projection_search as P

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=P.K, every=20):
    """Brute force over (id, vector)."""
    out = {}
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    for i, q in zip(ids, x):
        if i % every == 0 and i not in out:
            ip = (x * q).sum(axis=1)
            other = np.flatnonzero(ids != i)
            top = other[np.lexsort((ids[other], -ip[other]))][:k]
            out[int(i)] = [(int(ids[t]), float(ip[t])) for t in top]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(P.nearest(df, **kw).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({a for a, _ in got.get(q, [])} & {a for a, _ in w}) / max(1, len(w)) for q, w in want.items()])


@pytest.mark.parametrize("kind", ["sphere", "norms", "clusters"])
def test_recall_and_scores(spark, monkeypatch, kind):
    monkeypatch.setattr(P, "CELL_ROWS", 256)
    monkeypatch.setattr(P, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    if kind == "sphere":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 1500)] + 0.05 * x
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32))]
    got, want = run(spark, rows), plain(rows)
    assert recall(got, want) >= 0.93
    score = {(q, a): s for q, w in got.items() for a, s in w}
    for (q, a), s in score.items():
        assert s == pytest.approx(float((rows[a][1].astype(float) * rows[q][1].astype(float)).sum()), abs=1e-12)
    for w in got.values():
        assert w == sorted(w, key=lambda t: (-t[1], t[0])) and len(w) == P.K


def test_copies_ties_and_useless_vectors(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL_ROWS", 32)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32)) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(1000, 1200)]  # copies, split over tasks
    useless = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [float("inf")] + [1.0] * 7),
               (2100, [1.0, 2.0]), (None, [9.0] * 8)]
    got, want = run(spark, rows + useless), plain(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.93
    for q in (40, 1000):  # ties to the smaller id
        assert [a for a, _ in got[q]] == [a for a, _ in want[q]] and len({s for _, s in got[q]}) < 20


def test_fewer_candidates_than_asked_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    got = run(spark, rows)
    assert [a for a, _ in got[0]] == [1, 20, 20]
    assert set(a for a, _ in got[20]) == {0, 1}
    assert run(spark, [(0, [1.0, 2.0])]) == {}
    assert run(spark, [(0, None)]) == {} and run(spark, []) == {}
