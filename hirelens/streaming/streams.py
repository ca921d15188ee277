"""Structured Streaming jobs.

* merge stream   — each micro-batch of a scrape feed is overlaid onto the
                   standing dataset (retention, last-wins, first_seen) and
                   written as a NEW snapshot directory per epoch (idempotent on
                   replay: epoch e always merges onto the snapshot of e-1), or
                   onto a bucketed dataset of which a batch rewrites only the
                   buckets it meets (``start_bucket_merge_stream``).
* first-seen     — state by buckets of keys (``applyInPandasWithState``): emits a key the
                   first time it is sighted; every sighting renews an
                   event-time timeout, after which the key is forgotten and a
                   later sighting counts as new again.
* daily counts   — event-time windows of one day per platform with a
                   watermark; append mode emits a day once it is closed.
* facet refresh  — running facet counts in complete mode, each epoch's full
                   result written to its own snapshot directory; or a partial
                   aggregate an epoch, of which totals are sums
                   (``start_partial_stream``).

All sinks are files under folders the caller names (shared storage on a
cluster), with a checkpoint location per query so a restarted driver resumes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import presets
from ..operators import bucket_merge as BM
from ..operators import facets as FA
from ..operators import merge as M
from ..operators import partials as PA
from ..sources.chunks import _fs, read_text, write_text


def _epochs(spark: SparkSession, snapshot_dir: str) -> list[int]:
    fs, p = _fs(spark, snapshot_dir)
    if not fs.exists(p):
        return []
    out = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("epoch=") and fs.exists(
                spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot_dir}/{name}/_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def current_snapshot(spark: SparkSession, snapshot_dir: str) -> str | None:
    """Path of the live snapshot named by the ``current`` pointer file."""
    name = read_text(spark, f"{snapshot_dir.rstrip('/')}/current")
    return f"{snapshot_dir.rstrip('/')}/{name.strip()}" if name else None


def newest(batch: DataFrame, ts: str = "scraped_at") -> dt.datetime:
    """A batch's own clock: its latest timestamp (NTZ or instant, as UTC wall time); the epoch for an empty one."""
    us = batch.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()[0]
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us or 0)


def start_merge_stream(source: DataFrame, snapshot_dir: str, checkpoint: str,
                       now: dt.datetime | Callable[[DataFrame], dt.datetime] = newest,
                       key: str = "key", seq: str = "seq", scraped: str = "scraped_at",
                       max_days: int = presets.RETENTION_DAYS, available_now: bool = True,
                       keep: int = 3) -> StreamingQuery:
    """Overlay every micro-batch onto the previous epoch's snapshot. ``now`` is the
    retention clock: an instant, or a function of the batch that is asked for every
    batch, so that retention moves on in a stream that keeps running. Snapshots
    older than the ``keep`` newest are deleted."""
    snapshot_dir = snapshot_dir.rstrip("/")

    def merge_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        prior = [e for e in _epochs(spark, snapshot_dir) if e < epoch]
        if prior:
            existing = spark.read.parquet(f"{snapshot_dir}/epoch={prior[-1]}")
        else:
            existing = batch.limit(0).withColumn("first_seen", F.col(scraped))
        clock = now(batch) if callable(now) else now
        merged, _ = M.merge(existing, batch, clock, key, seq, scraped, max_days)
        merged.write.mode("overwrite").parquet(f"{snapshot_dir}/epoch={epoch}")
        write_text(spark, f"{snapshot_dir}/current", f"epoch={epoch}")
        fs, _ = _fs(spark, snapshot_dir)
        for old in [*prior, epoch][:-keep]:  # a replayed batch needs the epoch before it only
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot_dir}/epoch={old}"), True)

    w = source.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="6 hours")
    return w.start()


def start_bucket_merge_stream(source: DataFrame, root: str, checkpoint: str,
                              now: dt.datetime | Callable[[DataFrame], dt.datetime] = newest,
                              key: str = "key", seq: str = "seq", scraped: str = "scraped_at",
                              max_days: int = presets.RETENTION_DAYS, available_now: bool = True,
                              buckets: int = 64, locality: BM.Locality | None = None, keep: int = 3) -> StreamingQuery:
    """``start_merge_stream`` onto a bucketed dataset: epoch e is its version e. A replayed
    epoch starts from the version before it, so it gives the same snapshot."""

    def merge_batch(batch: DataFrame, epoch: int) -> None:
        clock = now(batch) if callable(now) else now
        BM.merge(batch.sparkSession, root, batch, clock, key, seq, scraped, max_days=max_days, version=epoch,
                 buckets=buckets, locality=locality, keep=keep)

    w = source.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="6 hours")
    return w.start()


FIRST_SEEN_OUT = "key string, first_seen long, seq long"  # times in microseconds since 1970
FIRST_SEEN_STATE = "keys array<string>, first_seen array<long>, latest array<long>"
FIRST_SEEN_BUCKETS = 1024


def first_seen_stream(source: DataFrame, key: str = "key", seq: str = "seq", ts: str = "scraped_at",
                      ttl_days: int = presets.RETENTION_DAYS + 1, watermark: str = "1 day",
                      buckets: int = FIRST_SEEN_BUCKETS) -> DataFrame:
    """(key, first_seen, seq) emitted once per key when it is first sighted
    (first_seen = the sighting's time; with several sightings of a new key in
    one batch, the last one by ``seq``). State expires ``ttl_days`` after the
    latest sighting — each sighting renews it.

    A bucket of keys is a group of the state: a group costs about as much whatever number of its keys are sighted. Its timeout
    is the earliest of its keys'. A checkpoint stays with the number of ``buckets`` that it began with."""
    ttl_ms = ttl_days * 86_400_000

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        if not state.hasTimedOut:
            # Fold the group's Arrow batches one at a time: memory is O(1) per key
            # even when one key carries a large share of a micro-batch.
            visits = {}
            for pdf in pdfs:
                if not len(pdf):
                    continue
                pdf = pdf.sort_values("_seq", kind="stable")
                own = pdf.groupby("_key", sort=False).agg(seq=("_seq", "last"), ts=("_us", "last"), latest=("_us", "max"))
                for name, s, t, latest in zip(own.index, own["seq"].tolist(), own["ts"].tolist(), own["latest"].tolist()):
                    v = visits.get(name)
                    if v is None:
                        visits[name] = (s, t, latest)
                    else:
                        visits[name] = (*((s, t) if s > v[0] else v[:2]), max(v[2], latest))
            new = {name: v for name, v in visits.items() if name not in held}
            for name, (_, t, latest) in visits.items():
                first, seen = held.get(name, (t, latest))
                held[name] = (first, max(seen, latest))
            if new:
                yield pd.DataFrame({"key": list(new), "first_seen": [v[1] for v in new.values()], "seq": [v[0] for v in new.values()]})
        passed = state.getCurrentWatermarkMs()
        held = {name: v for name, v in held.items() if v[1] // 1000 + ttl_ms >= passed}
        if not held:
            if state.exists:
                state.remove()
            return
        state.update((list(held), [v[0] for v in held.values()], [v[1] for v in held.values()]))
        state.setTimeoutTimestamp(min(v[1] for v in held.values()) // 1000 + ttl_ms)

    s = (source.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"), F.col(ts).cast("timestamp").alias("_ts"))
         .filter(F.coalesce(F.col("_key"), F.lit("")) != "")
         .withWatermark("_ts", watermark))
    s = s.withColumns({"_bucket": F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"), "_us": F.unix_micros("_ts")})
    found = s.groupBy("_bucket").applyInPandasWithState(step, FIRST_SEEN_OUT, FIRST_SEEN_STATE, "append",
                                                        GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("first_seen", F.timestamp_micros("first_seen"))


def daily_counts_stream(source: DataFrame, ts: str = "scraped_at", platform: str = "ats",
                        watermark: str = "1 day") -> DataFrame:
    """Per (day, platform) counts over event-time tumbling windows; with append
    output a day is emitted once the watermark passes its end."""
    s = source.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    return (s.groupBy(F.window("_ts", "1 day").alias("w"), F.col(platform).alias("platform"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.to_date(F.col("w.start")).alias("day"), "platform", "n"))


def start_facet_stream(source: DataFrame, out_dir: str, checkpoint: str, cols=("ats", "skill_level"),
                       available_now: bool = True, keep: int = 3) -> StreamingQuery:
    """Running facet counts; each epoch's complete result goes to its own folder. Folders older
    than the ``keep`` newest are deleted."""
    out_dir = out_dir.rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        prior = [e for e in _epochs(spark, out_dir) if e < epoch]
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
        write_text(spark, f"{out_dir}/current", f"epoch={epoch}")
        fs, _ = _fs(spark, out_dir)
        for old in [*prior, epoch][:-keep]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/epoch={old}"), True)

    agg = FA.facet_counts(source, cols)
    w = agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_partial_stream(source: DataFrame, root: str, checkpoint: str, cols=("ats", "skill_level"),
                         available_now: bool = True, fold: int = 32) -> StreamingQuery:
    """A partial aggregate of every micro-batch: an epoch writes its own counts and sketches only, a replayed one
    in place of what it wrote. Once ``fold`` epochs are there, all but the newest become one part. Totals
    are read with ``partials.read``; no state is kept."""
    root = root.rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        PA.put(spark, root, PA.partial(batch, F.lit(f"e{epoch:012d}"), cols))
        parts = sorted(PA.live(spark, root))
        if len(parts) > fold:
            PA.compact(spark, root, parts[:-1], parts[-2])

    w = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming DataFrame over everything available into Parquet files."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
