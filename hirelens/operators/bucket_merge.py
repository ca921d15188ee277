"""The keyed merge on a bucketed, versioned dataset: a batch rewrites only the buckets it meets.

    <root>/v=<version>/bucket=<b>/*.parquet   the buckets that a version has written
    <root>/manifest-<version>.json            for every bucket: the version that wrote it last, its rows, how far it is pruned
    <root>/current                            the live version

A key's bucket comes from a hash of its ``locality`` (the key itself, or a function of it, such as the company it names, which puts
keys that are scraped together into few buckets). A merge reads the buckets its batch meets, writes them anew under its
version and carries all others by reference. Same rows as ``merge.merge``: retention, last wins, first_seen kept. A carried
bucket isn't rewritten to drop rows that got too old: the manifest notes the latest clock, and readers apply the rule.

The batch is reduced to its winners first. Existing rows are then only matched by key (a join on the key alone, then an anti join),
so wide rows are neither sorted nor aggregated; the side of the winners is broadcast if Spark finds it small.

A version is written whole before its manifest, and the manifest before the pointer: a merge that is repeated after a
failure starts from the version before it and gives the same snapshot. The driver holds one manifest entry a bucket.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from ..session import materialize
from ..sources.chunks import _fs, read_text, write_text
from . import merge as M
from .search import epoch_micros

Locality = Callable[[Column], Column]


@dataclass
class Snapshot:
    """A version's manifest."""
    version: int
    buckets: int
    schema: T.StructType
    #: bucket -> (version that wrote it, rows written, micros of the latest clock since then or None)
    entries: dict[int, tuple[int, int, int | None]]

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "schema": self.schema.jsonValue(),
                           "entries": [[b, *e] for b, e in sorted(self.entries.items())]})


@dataclass
class Merged:
    version: int
    #: buckets written, and rows of the batch (duplicates included) whose key was not in the retained data
    touched: int
    new_count: int


def bucket_of(key: Column, buckets: int, locality: Locality | None = None) -> Column:
    return F.pmod(F.xxhash64(locality(key) if locality else key), F.lit(buckets)).cast("int")


def company_of(key: Column) -> Column:
    """The platform and company of a merge key, or the path of a URL without its last part."""
    return F.regexp_replace(key, r"[:/][^:/]*$", "")


def manifests(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[len("manifest-"):-len(".json")]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The named version, or the live one; None for a dataset that doesn't exist."""
    if version is None:
        name = read_text(spark, f"{root}/current")
        if name is None:
            return None
        version = int(name)
    m = json.loads(read_text(spark, f"{root}/manifest-{version}.json"))
    return Snapshot(m["version"], m["buckets"], T.StructType.fromJson(m["schema"]), {b: tuple(e) for b, *e in m["entries"]})


def _rows(spark: SparkSession, root: str, snap: Snapshot, buckets: list[int], scraped: str, max_days: int, now_us: int | None = None) -> DataFrame:
    """The retained rows of some buckets, with their bucket. ``now_us`` prunes further."""
    schema = T.StructType([*snap.schema.fields, T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())])
    held = [b for b in buckets if b in snap.entries]
    if not held:
        return spark.createDataFrame([], schema).drop("v")
    paths = [f"{root}/v={snap.entries[b][0]}/bucket={b}" for b in held]
    rows = spark.read.schema(schema).option("basePath", root).parquet(*paths).drop("v")
    clocks = [(b, max([c for c in (snap.entries[b][2], now_us) if c is not None], default=None)) for b in held]
    if all(c is None for _, c in clocks):
        return rows
    if len({c for _, c in clocks}) == 1:
        return rows.filter(~M.stale_at(rows, scraped, F.lit(clocks[0][1]), max_days))
    pruned = spark.createDataFrame(clocks, "bucket int, __pruned long")
    rows = rows.join(F.broadcast(pruned), "bucket")  # a row a bucket
    return rows.filter(~M.stale_at(rows, scraped, F.col("__pruned"), max_days)).drop("__pruned")


def read(spark: SparkSession, root: str, version: int | None = None, scraped: str = "scraped_at", max_days: int = presets.RETENTION_DAYS) -> DataFrame:
    """The rows of a version (the live one by default)."""
    root = root.rstrip("/")
    snap = snapshot(spark, root, version)
    if snap is None:
        raise FileNotFoundError(root)
    return _rows(spark, root, snap, sorted(snap.entries), scraped, max_days).drop("bucket")


def _write(spark: SparkSession, root: str, rows: DataFrame, version: int, key: str, files: int) -> dict[int, int]:
    """Write a version's buckets; the rows of each."""
    path = f"{root}/v={version}"
    dealt = rows.repartition("bucket") if files == 1 else rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(files)))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = spark.read.schema("bucket int").parquet(path)
    return {r.bucket: r.n for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


def _publish(spark: SparkSession, root: str, snap: Snapshot, keep: int) -> None:
    write_text(spark, f"{root}/manifest-{snap.version}.json", snap.text())
    write_text(spark, f"{root}/current", str(snap.version))
    vacuum(spark, root, keep)


def load(spark: SparkSession, root: str, rows: DataFrame, buckets: int, key: str = "key", seq: str = "seq", now: dt.datetime | None = None, scraped: str = "scraped_at",
         first_seen: str = "first_seen", max_days: int = presets.RETENTION_DAYS, locality: Locality | None = None, files: int = 1) -> Snapshot:
    """Start a dataset as version 0 from standing rows: those of empty keys, and (with ``now``) those too old, go; of a key's rows the last stays."""
    root = root.rstrip("/")
    if first_seen not in rows.columns:
        rows = rows.withColumn(first_seen, F.lit(None).cast(rows.schema[scraped].dataType))
    kept = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
    if now is not None:
        kept = M.retain(kept, scraped, now, max_days)
    kept = M.dedup_last(kept, [key], [seq]).select(*rows.columns)
    counts = _write(spark, root, kept.withColumn("bucket", bucket_of(F.col(key), buckets, locality)), 0, key, files)
    snap = Snapshot(0, buckets, T.StructType([T.StructField(f.name, f.dataType) for f in kept.schema]), {b: (0, n, None) for b, n in counts.items()})
    _publish(spark, root, snap, 1)
    return snap


def merge(spark: SparkSession, root: str, batch: DataFrame, now: dt.datetime, key: str = "key", seq: str = "seq", scraped: str = "scraped_at", first_seen: str = "first_seen",
          max_days: int = presets.RETENTION_DAYS, version: int | None = None, buckets: int = 64, locality: Locality | None = None, files: int = 1, keep: int = 3) -> Merged:
    """Overlay a batch onto the latest version before ``version`` (by default: onto the live one) and publish the result. ``buckets``
    counts for the first version only; ``locality`` must stay the same. Versions before the ``keep`` newest are deleted."""
    root = root.rstrip("/")
    before = [v for v in manifests(spark, root) if version is None or v < version]
    prior = snapshot(spark, root, before[-1]) if before else None
    if prior is None:
        own = [f for f in batch.schema if f.name != first_seen]
        prior = Snapshot(-1, buckets, T.StructType([*own, T.StructField(first_seen, batch.schema[scraped].dataType)]), {})
    version = prior.version + 1 if version is None else version
    clock = epoch_micros(now)

    # the batch's winners, and how many rows each stands for
    keyed = batch.drop(first_seen).filter(F.coalesce(F.col(key), F.lit("")) != "")
    others = [c for c in keyed.columns if c != key]
    won = keyed.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(seq)).alias("__w"), F.count(F.lit(1)).alias("__n"))
    won = materialize(won.select(key, "__w.*", "__n", bucket_of(F.col(key), prior.buckets, locality).alias("bucket")), "winners")
    met = [r.bucket for r in won.select("bucket").distinct().collect()]  # one number a bucket at most

    existing = _rows(spark, root, prior, met, scraped, max_days, clock)
    keys = won.select(key)
    known = existing.select(key, F.col(first_seen).alias("__seen")).join(keys, key)
    found = won.join(known.withColumn("__known", F.lit(True)), key, "left")
    new = F.coalesce("__known", F.lit(False))
    # F.when keeps a known row's null first_seen
    winners = found.withColumn(first_seen, F.when(new, F.col("__seen")).otherwise(F.col(scraped).cast(prior.schema[first_seen].dataType)))
    merged = winners.drop("__seen", "__known", "__n").unionByName(existing.join(keys, key, "left_anti"), allowMissingColumns=True)
    counts = _write(spark, root, merged, version, key, files)
    new_count = found.filter(~new).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first().n

    fields = {f.name: T.StructField(f.name, f.dataType) for f in merged.schema if f.name != "bucket"}
    carried = {b: (v, n, clock if c is None else max(c, clock)) for b, (v, n, c) in prior.entries.items() if b not in counts}
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in prior.schema), *(f for name, f in fields.items() if name not in prior.schema.names)])
    _publish(spark, root, Snapshot(version, prior.buckets, schema, carried | {b: (version, n, None) for b, n in counts.items()}), keep)
    return Merged(version, len(counts), new_count)


def vacuum(spark: SparkSession, root: str, keep: int) -> None:
    """Delete the manifests before the ``keep`` newest, and the buckets that no manifest left names."""
    fs, p = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    versions = manifests(spark, root)
    old, kept = versions[:-keep], versions[-keep:]
    if not old:
        return
    named = {(e[0], b) for v in kept for b, e in snapshot(spark, root, v).entries.items()}
    gone = {(e[0], b) for v in old for b, e in snapshot(spark, root, v).entries.items()} - named
    for v, b in gone:
        fs.delete(path(f"{root}/v={v}/bucket={b}"), True)
    for v in old:
        fs.delete(path(f"{root}/manifest-{v}.json"), False)
    for v in {v for v, _ in gone} - {v for v, _ in named}:
        fs.delete(path(f"{root}/v={v}"), True)
