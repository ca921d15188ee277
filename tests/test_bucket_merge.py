"""The bucketed merge: the plain merge's rows, few bytes written, replays, pruning by clock, dropped versions."""

import datetime as dt
import os
import random

import pytest

from hirelens.operators import bucket_merge as BM
from hirelens.operators import merge as M
from hirelens.streaming import streams as ST

SCHEMA = "key string, seq long, scraped_at timestamp_ntz, payload string"
DAY0 = dt.datetime(2030, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def rows_of(df):
    return sorted((r.key, r.seq, r.scraped_at, r.payload, r.first_seen) for r in df.collect())


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


@pytest.mark.parametrize("locality", [None, BM.company_of], ids=["key", "company"])
def test_history_equals_the_plain_merge(spark, tmp_path, locality):
    rng = random.Random(5)
    root, standing, seq = f"{tmp_path}/t", None, 0
    for n in range(5):
        batch = []
        for _ in range(60):
            seq += 1
            key = rng.choice([None, "", *[f"p:c{rng.randrange(9)}:{rng.randrange(12)}"] * 9])
            batch.append((key, seq, rng.choice([None, day(n * 9 - rng.randrange(40))]), f"x{seq}"))
        df = spark.createDataFrame(batch, SCHEMA)
        # clocks may go back: what an earlier one pruned stays pruned
        clock = day(n * 9 if n != 3 else 2)
        empty = spark.createDataFrame([], SCHEMA + ", first_seen timestamp_ntz")
        old = spark.createDataFrame(standing, SCHEMA + ", first_seen timestamp_ntz") if standing else empty
        want, count = M.merge(old, df, clock)
        got = BM.merge(spark, root, df, clock, buckets=7, locality=locality)
        assert got.new_count == count.first().new_count and got.version == n
        standing = [tuple(r) for r in want.select("key", "seq", "scraped_at", "payload", "first_seen").collect()]
        assert rows_of(BM.read(spark, root)) == sorted(standing, key=lambda r: r[:2])
    assert BM.manifests(spark, root) == [2, 3, 4]


def test_a_small_batch_writes_few_bytes(spark, tmp_path):
    root = f"{tmp_path}/t"
    base = spark.range(50_000).selectExpr("concat('p:c', id % 100, ':', id) AS key", "id AS seq", "timestamp_ntz'2030-01-01' AS scraped_at", "sha2(string(id), 256) AS payload")
    BM.load(spark, root, base, 100, locality=BM.company_of)
    whole = bytes_below(f"{root}/v=0")
    one = base.filter("key LIKE 'p:c17:%'").selectExpr("key", "seq + 1000000 AS seq", "timestamp_ntz'2030-01-02' AS scraped_at", "payload")
    got = BM.merge(spark, root, one, day(2), locality=BM.company_of)
    assert got.touched == 1 and got.new_count == 0
    assert bytes_below(f"{root}/v=1") < 0.05 * whole  # a bucket holds one company on average, some hold a few
    now = BM.read(spark, root)
    assert now.count() == 50_000 and now.filter("seq >= 1000000").count() == one.count()
    assert BM.read(spark, root, 0).filter("seq >= 1000000").count() == 0  # the version before


def test_replay_gives_the_same_snapshot(spark, tmp_path):
    root = f"{tmp_path}/t"
    first = spark.createDataFrame([(f"p:c{k}:1", k, day(0), "x") for k in range(20)], SCHEMA)
    second = spark.createDataFrame([("p:c3:1", 50, day(1), "y"), ("p:c30:1", 51, day(1), "y"), ("p:c30:1", 52, day(1), "z")], SCHEMA)
    BM.merge(spark, root, first, day(0), version=0, buckets=8)
    one = BM.merge(spark, root, second, day(1), version=1)
    want = rows_of(BM.read(spark, root))
    again = BM.merge(spark, root, second, day(1), version=1)  # the epoch comes again
    assert again == one and one.new_count == 2 and rows_of(BM.read(spark, root)) == want
    # a merge that died before its manifest leaves files that no reader sees
    os.makedirs(f"{root}/v=2/bucket=0")
    assert rows_of(BM.read(spark, root)) == want


def test_carried_buckets_are_pruned_for_readers_and_unnamed_ones_deleted(spark, tmp_path):
    root = f"{tmp_path}/t"
    BM.merge(spark, root, spark.createDataFrame([("a", 1, day(0), "x"), ("b", 2, day(20), "x")], SCHEMA), day(20), buckets=1000)
    for n in range(1, 5):
        BM.merge(spark, root, spark.createDataFrame([("c", 2 + n, day(30 + n), "x")], SCHEMA), day(30 + n))
    assert [r[0] for r in rows_of(BM.read(spark, root))] == ["b", "c"]  # "a" is 34 days old, its bucket was never rewritten
    got = BM.merge(spark, root, spark.createDataFrame([("a", 9, day(36), "again")], SCHEMA), day(36))
    assert got.new_count == 1 and [r[4] for r in rows_of(BM.read(spark, root)) if r[0] == "a"] == [day(36)]
    snap = BM.snapshot(spark, root)
    held = {(v, b) for m in BM.manifests(spark, root) for b, (v, _, _) in BM.snapshot(spark, root, m).entries.items()}
    on_disk = {(int(v[2:]), int(b[7:])) for v in os.listdir(root) if v.startswith("v=") for b in os.listdir(f"{root}/{v}") if b.startswith("bucket=")}
    assert held == on_disk and len(snap.entries) == 3


def test_empty_batches_and_new_columns(spark, tmp_path):
    root = f"{tmp_path}/t"
    BM.load(spark, root, spark.createDataFrame([("a", 1, day(0), "x"), ("a", 2, day(0), "y"), ("", 3, day(0), "x")], SCHEMA), 4)
    assert BM.merge(spark, root, spark.createDataFrame([], SCHEMA), day(1)) == BM.Merged(1, 0, 0)
    wide = spark.createDataFrame([("b", 4, day(1), 7)], "key string, seq long, scraped_at timestamp_ntz, extra int")
    BM.merge(spark, root, wide, day(1))
    assert sorted((r.key, r.seq, r.payload, r.extra, r.first_seen) for r in BM.read(spark, root).collect()) == [("a", 2, "y", None, None), ("b", 4, None, 7, day(1))]
    with pytest.raises(FileNotFoundError):
        BM.read(spark, f"{tmp_path}/none")


def test_stream_resumes(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ST.start_bucket_merge_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/ckpt", buckets=8).awaitTermination()
        return {r.key: r for r in BM.read(spark, f"{tmp_path}/t").collect()}

    assert set(arrive([("a", 1, day(0), "x"), ("b", 2, day(1), "x")])) == {"a", "b"}
    assert set(arrive([("b", 3, day(20), "y")])) == {"a", "b"}
    got = arrive([("c", 4, day(40), "z")])
    assert set(got) == {"b", "c"} and got["b"].first_seen == day(1) and got["b"].payload == "y"
    assert arrive([("a", 5, day(41), "again")])["a"].first_seen == day(41)
