"""State by buckets of keys: as many state rows as buckets at most, each key with its own times."""

import datetime as dt

import pytest

from hirelens.streaming import streams as ST
from hirelens.streaming import timers

SCHEMA = "key string, seq long, scraped_at timestamp"
DAY0 = dt.datetime(2030, 1, 1, tzinfo=dt.timezone.utc)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def arrive(spark, path, rows, start):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    ST.run_to_files(start(spark.readStream.schema(SCHEMA).parquet(f"{path}/in")), f"{path}/out", f"{path}/ckpt")
    return sorted((r.key, r.seq, r.d) for r in spark.read.parquet(f"{path}/out").selectExpr("key", "seq", "datediff(first_seen, date'2030-01-01') AS d").collect())


def first_seen(source):
    return ST.first_seen_stream(source, ttl_days=10, buckets=2)


def sightings(source):
    return timers.sightings(source, dt.timedelta(days=10), buckets=2)


@pytest.mark.parametrize("start", [first_seen, sightings])
def test_keys_of_a_bucket_have_their_own_times(spark, tmp_path, start):
    path, keys = str(tmp_path), [f"k{i}" for i in range(20)]
    rows = [(k, i, day(0)) for i, k in enumerate(keys)] + [("k0", 50, day(1)), ("k0", 40, day(2))]
    want = [("k0", 50, 1)] + [(k, i, 0) for i, k in enumerate(keys) if i]
    assert arrive(spark, path, rows, start) == sorted(want)
    # half of them are renewed, the others expire (10) before the watermark (15)
    assert arrive(spark, path, [(k, 100 + i, day(8)) for i, k in enumerate(keys[:10])], start) == sorted(want)
    want.append(("new", 200, 16))
    assert arrive(spark, path, [("new", 200, day(16))], start) == sorted(want)
    want += [("k15", 301, 17)]
    assert arrive(spark, path, [("k5", 300, day(17)), ("k15", 301, day(17))], start) == sorted(want)
    if start is sightings:
        held = timers.held_keys(spark, f"{path}/ckpt")
        assert {r.key for r in held.collect()} == {*keys[:10], "new", "k15"}
        state = spark.read.format("statestore").option("path", f"{path}/ckpt").option("stateVarName", timers.STATE).load()
    else:
        state = spark.read.format("statestore").load(f"{path}/ckpt")
    assert 1 <= state.count() <= 2
