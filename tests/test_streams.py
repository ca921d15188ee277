"""The merge stream's clock and its old snapshots."""

import datetime as dt
import os

from hirelens.streaming import streams as ST

SCHEMA = "key string, seq long, scraped_at timestamp_ntz, payload string"


def arrive(spark, path, rows, **kw):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    q = ST.start_merge_stream(spark.readStream.schema(SCHEMA).parquet(f"{path}/in"), f"{path}/out", f"{path}/ckpt", **kw)
    q.awaitTermination()
    return {r.key: r for r in spark.read.parquet(ST.current_snapshot(spark, f"{path}/out")).collect()}


def test_retention_follows_the_batches(spark, tmp_path):
    day = lambda n: dt.datetime(2030, 1, 1) + dt.timedelta(days=n)
    path = str(tmp_path)
    assert set(arrive(spark, path, [("a", 1, day(0), "x"), ("b", 2, day(1), "x")])) == {"a", "b"}
    assert set(arrive(spark, path, [("b", 3, day(20), "y")])) == {"a", "b"}
    got = arrive(spark, path, [("c", 4, day(40), "z")])  # by now "a" is too old, "b" is not
    assert set(got) == {"b", "c"} and got["b"].first_seen == day(1) and got["b"].payload == "y"
    got = arrive(spark, path, [("a", 5, day(41), "again")])
    assert got["a"].first_seen == day(41)  # pruned, so new again
    assert sorted(d for d in os.listdir(f"{path}/out") if d.startswith("epoch=")) == ["epoch=1", "epoch=2", "epoch=3"]


def test_a_fixed_clock_stays(spark, tmp_path):
    at = dt.datetime(2030, 1, 1)
    rows = [("a", 1, at - dt.timedelta(days=400), "x")]
    assert set(arrive(spark, str(tmp_path), rows, now=at)) == {"a"}  # the new side is not pruned
    assert set(arrive(spark, str(tmp_path), [("b", 2, at, "x")], now=at)) == {"b"}
