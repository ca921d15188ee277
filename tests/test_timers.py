"""First sightings with timers: emitted again after the time to live, renewed in time, state gone once expired."""

import datetime as dt

import pyarrow as pa

from hirelens.streaming import streams as ST
from hirelens.streaming import timers

SCHEMA = "key string, seq long, scraped_at timestamp"
DAY0 = dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def arrive(spark, path, rows, ttl):
    """One run arrives; all emissions so far, and the keys held."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = timers.sightings(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), dt.timedelta(days=ttl))
    ST.run_to_files(stream, f"{path}/out", f"{path}/ckpt")
    out = sorted((r.key, r.seq, r.d) for r in spark.read.parquet(f"{path}/out").selectExpr("key", "seq", "datediff(first_seen, date'2030-01-01') AS d").collect())
    return out, {r.key for r in timers.held_keys(spark, f"{path}/ckpt").collect()}


def test_renewed_in_time_expired_and_cleared(spark, tmp_path):
    path = str(tmp_path)
    rows = [("a", 1, day(0)), ("b", 2, day(0)), ("c", 3, day(0)), (None, 4, day(0)), ("", 5, day(0)), ("x", 6, None)]
    want = [("a", 1, 0), ("b", 2, 0), ("c", 3, 0)]
    assert arrive(spark, path, rows, 10) == (want, {"a", "b", "c"})
    # "a" is renewed twice, of two sightings in one visit the last counts; "b" stays away
    assert arrive(spark, path, [("a", 7, day(8)), ("d", 9, day(8)), ("d", 8, day(9))], 10) == (want + [("d", 9, 8)], {"a", "b", "c", "d"})
    # the watermark (15) has passed "b" and "c" (10), not "a" (18) and "d" (19)
    out, held = arrive(spark, path, [("a", 10, day(16))], 10)
    assert out == want + [("d", 9, 8)] and held == {"a", "d"}
    # "b" comes back: new again. "d" comes at its very end, before the watermark got there: new again, too
    out, held = arrive(spark, path, [("b", 11, day(17)), ("d", 12, day(19))], 10)
    assert out == sorted(want + [("d", 9, 8), ("b", 11, 17), ("d", 12, 19)]) and held == {"a", "b", "d"}
    # far later: all but the new one are gone
    out, held = arrive(spark, path, [("e", 13, day(90))], 10)
    assert held == {"e"} and ("e", 13, 90) in out
    # later than the watermark allows
    assert arrive(spark, path, [("f", 14, day(50))], 10) == (out, {"e"})


def test_fold_keeps_earliest_latest_and_last():
    rows = pa.record_batch({"key": ["k", "k", "j", "k"], "ts": [3, 1, 5, 2], "seq": [1, 7, 2, 4]})
    got = {r["key"]: r for b in timers.fold(iter([rows])) for r in b.to_pylist()}
    assert {k: (r["earliest"], r["latest"], r["seq"], r["last"]) for k, r in got.items()} == {"k": (1, 3, 7, 1), "j": (5, 5, 2, 5)}
