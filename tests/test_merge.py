"""Merge and retention against an independent row loop over a generated history."""

import datetime as dt
import random

import pytest

from hirelens.functions.classify import dedup_key
from hirelens.operators import merge as M

NOW = dt.datetime(2031, 6, 30, 12)
SCHEMA = "key string, scraped_at string, first_seen string, payload long, seq long"


def stamp(days, zone="Z"):
    return (NOW - dt.timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S") + zone


def keeps(scraped):
    """Retention, spelled out: only an instant with a zone can be too old."""
    if scraped is None or not scraped.endswith(("Z", "+00:00")):
        return True
    try:
        at = dt.datetime.fromisoformat(scraped.replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return True
    return (NOW - at).days <= 30


def replay(standing, scrape):
    """standing: {key: row}; one scrape merged into it, row by row. Returns (standing, new rows)."""
    kept = {k: r for k, r in standing.items() if k and keeps(r["scraped_at"])}
    out, fresh = dict(kept), 0
    for r in scrape:
        if not r["key"]:
            continue
        old = kept.get(r["key"])
        fresh += old is None
        out[r["key"]] = r | {"first_seen": r["scraped_at"] if old is None else old["first_seen"]}
    return out, fresh


def frame(spark, rows):
    return spark.createDataFrame([(r["key"], r["scraped_at"], r.get("first_seen"), r["payload"], i) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_history_of_scrapes(spark, seed):
    rng = random.Random(seed)
    ages = [lambda: rng.uniform(0, 70), lambda: 31.0, lambda: 31 - 1 / 86400, lambda: -rng.uniform(0, 5)]
    row = lambda k, p: {"key": k, "payload": p, "scraped_at": rng.choice([stamp(rng.choice(ages)()), stamp(rng.uniform(0, 70), "+00:00"), stamp(50, ""), "last week", None])}
    keys = ["", None, *(f"job-{i}" for i in range(14))]
    standing = {k: row(k, i) | {"first_seen": rng.choice([None, stamp(90), stamp(3)])} for i, k in enumerate(keys[:9]) if k}
    for step in range(3):
        scrape = [row(rng.choice(keys), 100 * step + i) for i in range(rng.choice([0, 1, 12, 25]))]
        merged, n = M.merge(frame(spark, list(standing.values())), frame(spark, scrape).drop("first_seen"), NOW)
        meta = M.merge_metadata(merged, n, NOW).first()
        want, fresh = replay(standing, scrape)
        got = {r.key: r for r in merged.collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            assert (got[k].payload, got[k].scraped_at, got[k].first_seen) == (r["payload"], r["scraped_at"], r["first_seen"])
        assert (meta.total_jobs, meta.new_jobs, meta.last_updated) == (len(want), fresh, "2031-06-30T12:00:00Z")
        stale = sum(1 for k, r in standing.items() if not keeps(r["scraped_at"]))
        assert M.stale_count(frame(spark, list(standing.values())), "key", "scraped_at", NOW).first()[0] == stale
        standing = want


def test_either_side_may_have_columns_of_its_own(spark):
    old = spark.createDataFrame([("a", "t0", "f0", 1, "DE"), ("b", "t0", None, 2, "FR")], "key string, scraped_at string, first_seen string, seq long, country string")
    new = spark.createDataFrame([("b", "t1", 7, 2.5), ("c", "t1", 8, 3.5)], "key string, scraped_at string, seq long, pay double")
    merged, n = M.overlay(old, new)
    got = {r.key: r.asDict() for r in merged.collect()}
    assert got["a"] == {"key": "a", "scraped_at": "t0", "first_seen": "f0", "seq": 1, "country": "DE", "pay": None}
    assert got["b"] == {"key": "b", "scraped_at": "t1", "first_seen": None, "seq": 7, "country": None, "pay": 2.5}
    assert got["c"] == {"key": "c", "scraped_at": "t1", "first_seen": "t1", "seq": 8, "country": None, "pay": 3.5}
    assert n.first()[0] == 1


def test_merge_keys_by_platform(spark):
    cases = {
        ("https://big.wd5.myworkdayjobs.com/ext/job/Oslo/jobs/77/x", "Workday", "big", None, "A"): "workday:big:77",
        ("https://big.wd5.myworkdayjobs.com/ext/job/Oslo/R-1", "Workday", "big", None, "A"): "https://big.wd5.myworkdayjobs.com/ext/job/Oslo/R-1",
        ("https://pay/1", "Paylocity", "Nord", "5150", "A"): "paylocity:5150",
        ("https://pay/2", "Paylocity", "Nord", None, "Cook"): "paylocity:Nord:Cook",
        ("https://lev/3", "Lever", "nord", "3", "A"): "https://lev/3",
    }
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, url string, ats string, company string, id string, title string")
    got = {r.n: r.k for r in df.select("n", dedup_key().alias("k")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_statuses_follow_the_last_change(spark):
    rng = random.Random(3)
    stored = {f"u{i}": "saved" for i in range(6)}
    changes = [(f"u{rng.randrange(10)}", rng.choice(["saved", "applied", "ignored"]), None, i) for i in range(30)]
    rng.shuffle(changes)
    st = spark.createDataFrame([(u, s, None) for u, s in stored.items()], "url string, status string, date date")
    ch = spark.createDataFrame(changes, "url string, status string, date date, seq long")
    for u, s, _, _ in sorted(changes, key=lambda c: c[3]):
        stored[u] = s
    assert {r.url: r.status for r in M.upsert_status(st, ch).collect()} == stored
    gone = spark.createDataFrame([("u1",), ("u1",), ("other",)], "url string")
    assert {r.url for r in M.delete_status(st, gone).collect()} == {f"u{i}" for i in range(6)} - {"u1"}
