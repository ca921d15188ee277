"""First sightings with a time to live: ``transformWithState``, one value state and one event-time timer a bucket of keys.

A key is emitted when it is first sighted, and again when a sighting comes ``ttl`` or more after the latest one before
it; any sighting in time renews it, so that it expires at latest sighting + ttl. Once the watermark has passed that, the key is dropped, so
the state holds the keys of the last ttl and of the watermark's delay only.

Keys are dealt to buckets by hash. A call of the state store costs far more than a key, and a bucket needs the same few calls
whatever number of its keys are sighted; its timer stands at the earliest expiry among them. A bucket's keys are in memory one bucket at a
time: take more ``buckets`` where far more keys are held. A checkpoint stays with the number that it began with.

Sightings are folded per key before the shuffle (earliest, latest, and the last by ``seq``), so that a key with a third of all
rows reaches the state as a few rows. The sightings of one micro-batch count as one visit: gaps inside it don't.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from .. import presets

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "sighted"
BUCKETS = 1024
# times in microseconds since 1970: Python state would lose a timestamp's zone
_OUT = "key string, first_seen long, seq long"
_FOLDED = "key string, earliest long, latest long, seq long, last long"
_HELD = "keys array<string>, first_seen array<long>, latest array<long>, expires array<long>, timer long"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers need this provider; a session's streams share it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, ts, seq) of each batch -> one row a key: earliest and latest ts, and the greatest seq with its ts."""
    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by([("seq", "ascending")])
        own = rows.group_by("key", use_threads=False).aggregate([("ts", "min"), ("ts", "max"), ("seq", "last"), ("ts", "last")])
        own = own.select(["key", "ts_min", "ts_max", "seq_last", "ts_last"]).rename_columns(["key", "earliest", "latest", "seq", "last"])
        yield from own.to_batches()


class Sightings(StatefulProcessor):
    def __init__(self, ttl: dt.timedelta):
        self.ttl_ms = int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sighted = handle.getValueState(STATE, _HELD)

    def _held(self) -> tuple[dict, int | None]:
        """key -> (first, latest, expires) of the bucket, and where its timer stands."""
        row = self.sighted.get()
        if row is None:
            return {}, None
        keys, firsts, latests, expires, timer = row
        return dict(zip(keys, zip(firsts, latests, expires))), timer

    def _keep(self, held: dict, timer: int | None) -> None:
        """Store the bucket with its timer at the earliest expiry; ``timer`` is the one that stands."""
        if not held:
            self.sighted.clear()
            return
        firsts, latests, expires = map(list, zip(*held.values()))
        first_out = min(expires)
        if timer != first_out:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first_out)
        self.sighted.update((list(held), firsts, latests, expires, first_out))

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[Row]:
        visits = {}
        for r in rows:
            v = visits.get(r.key)
            if v is None:
                visits[r.key] = (r.earliest, r.latest, r.seq, r.last)
            else:
                visits[r.key] = (min(v[0], r.earliest), max(v[1], r.latest), *((r.seq, r.last) if r.seq > v[2] else v[2:]))
        held, timer = self._held()
        for k, (earliest, latest, seq, last) in visits.items():
            was = held.get(k)
            if was is not None and earliest // 1000 < was[2]:
                first, latest = was[0], max(was[1], latest)
            else:
                first = last
                yield Row(key=k, first_seen=first, seq=seq)
            held[k] = (first, latest, latest // 1000 + self.ttl_ms)  # timers are in milliseconds
        self._keep(held, timer)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held, _ = self._held()
        passed = timerValues.getCurrentWatermarkInMs()
        self._keep({k: v for k, v in held.items() if v[2] >= passed}, None)  # the timer that fired is gone
        return iter(())

    def close(self) -> None:
        pass


def sightings(source: DataFrame, ttl: dt.timedelta = dt.timedelta(days=presets.RETENTION_DAYS + 1), key: str = "key", seq: str = "seq",
              ts: str = "scraped_at", watermark: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """(key, first_seen, seq): the last sighting by ``seq`` of every visit of a new or forgotten key. Rows without key or time, and
    those later than the watermark allows, take no part."""
    use_rocksdb(source.sparkSession)
    rows = source.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(seq).cast("long").alias("seq"))
    rows = rows.filter((F.coalesce("key", F.lit("")) != "") & F.col("ts").isNotNull() & F.col("seq").isNotNull())
    folded = rows.mapInArrow(fold, _FOLDED).withColumn("at", F.timestamp_micros("latest")).withWatermark("at", watermark)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    found = folded.withColumn("bucket", bucket).groupBy("bucket").transformWithState(Sightings(ttl), _OUT, "append", "EventTime")
    return found.withColumn("first_seen", F.timestamp_micros("first_seen"))


def held_keys(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keys whose state a stopped stream holds, read from its checkpoint: key, first_seen, latest, expires."""
    use_rocksdb(spark)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE).load()
    state = state.select(F.inline(F.arrays_zip(*[f"value.{c}" for c in ("keys", "first_seen", "latest", "expires")])))
    times = [F.timestamp_micros(c).alias(c) for c in ("first_seen", "latest")]
    return state.select(F.col("keys").alias("key"), *times, F.timestamp_millis("expires").alias("expires"))
