"""Chunked dataset on shared storage: ``<dir>/chunks/jobs_manifest.json`` +
one gzip JSON file per chunk of at most ``size`` rows, in publish order.

Chunk numbering is exact without a single-partition window: rows are range
partitioned on the publish order, sorted within partitions and stored
(``operators.order_index``); a table of partition sizes, joined with them, gives each
row's global index: its partition's offset plus its position in the partition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from ..operators import order_index

MANIFEST = "jobs_manifest.json"
FRONTEND_FIELDS = ["title", "company", "location", "url", "ats", "skill_level", "is_recruiter", "workplaceType",
                   "scraped_at", "remote", "coords", "country", "salary", "updated_at", "first_seen"]


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file (manifests, pointers) through the Hadoop FS: to a
    file beside it, which then takes its place, so no reader sees half of it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, p = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(part), fs.makeQualified(p), how)


def read_text(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Readers that are opened here list their folders in a few tasks a core; Spark's default is a task a folder, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def listing(spark: SparkSession, base: str) -> DataFrame:
    """(file) of every chunk file below ``base`` that holds anything, by one listing; names relative to it."""
    if not exists(spark, base):
        return spark.createDataFrame([], "file string")
    with _few_listing_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(base)
    return files.select(F.element_at(F.split("path", "/chunks/"), -1).alias("file"))


def slim(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Project to the frontend fields that exist (plus ``keep``)."""
    cols = [c for c in FRONTEND_FIELDS if c in df.columns] + [c for c in (keep or []) if c in df.columns]
    return df.select(*cols)


def number_rows(df: DataFrame, order: list, partitions: int) -> tuple[DataFrame, int]:
    """Add ``_idx`` = 0-based global position in ``order`` (exact, distributed).
    Returns (numbered rows, total row count)."""
    index = order_index.build(df, order, partitions)
    return index.numbered(), index.total


def write_chunks(df: DataFrame, out_dir: str, timestamp: str, size: int = presets.CHUNK_SIZE,
                 tie: str | None = None) -> dict:
    """Publish order = (lower(company), lower(title)[, tie]); chunk k holds rows
    [k*size, (k+1)*size) in that order. Each chunk is one file holding one JSON array,
    ``chunks/data/chunk_id=k/part-*.gz``; a task writes several chunks.
    Returns the manifest."""
    spark = df.sparkSession
    order = [F.lower(F.coalesce(F.col("company"), F.lit(""))), F.lower(F.coalesce(F.col("title"), F.lit("")))]
    if tie:
        order.append(F.col(tie))
    total_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered, total = number_rows(df, order, total_parts)
    n_chunks = -(-total // size)
    chunk, at = F.floor(F.col("_idx") / size).cast("bigint"), F.col("_idx") % size
    last = (at == size - 1) | (F.col("_idx") == total - 1)
    # lines that together are one JSON array
    line = F.concat(F.when(at == 0, F.lit("[")).otherwise(F.lit("")), F.to_json(F.struct(*df.columns)),
                    F.when(last, F.lit("]")).otherwise(F.lit(",")))
    base = out_dir.rstrip("/") + "/chunks"
    (numbered.select(chunk.alias("chunk_id"), "_idx", line.alias("value"))
     .repartition(max(1, min(n_chunks, total_parts)), "chunk_id").sortWithinPartitions("chunk_id", "_idx").drop("_idx")
     .write.mode("errorifexists").option("compression", "gzip").partitionBy("chunk_id").text(base + "/data"))
    number = F.regexp_extract("file", r"chunk_id=(\d+)", 1).cast("bigint")
    files = [r.file for r in listing(spark, base).filter(F.col("file").startswith("data/")).orderBy(number).collect()]
    # every chunk is full except the last: sizes follow from the total
    manifest = {"chunks": files, "totalJobs": total, "last_updated": timestamp,
                "chunkRows": {str(k): min(size, total - k * size) for k in range(n_chunks)}}
    write_text(spark, f"{base}/{MANIFEST}", json.dumps(manifest, indent=2))
    return manifest


def read_manifest(spark: SparkSession, directory: str) -> dict | None:
    text = read_text(spark, directory.rstrip("/") + "/chunks/" + MANIFEST)
    return json.loads(text) if text else None


def listed_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """(file, there) of every file that the manifest names; not there: missing or empty."""
    base = directory.rstrip("/") + "/chunks"
    names = spark.createDataFrame([(f,) for f in (read_manifest(spark, directory) or {}).get("chunks") or []], "file string")
    return names.join(listing(spark, base).withColumn("there", F.lit(True)), "file", "left").fillna(False, "there")


def missing_chunks(spark: SparkSession, directory: str) -> DataFrame:
    """(file) named by the manifest but missing or empty: what ``read_chunks`` skips."""
    return listed_chunks(spark, directory).filter("NOT there").select("file")


def read_chunks(spark: SparkSession, directory: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows of the files named in the manifest, each one JSON array. No manifest ->
    empty. A listed file that is missing is skipped (``missing_chunks`` tells which);
    ``strict=True`` raises instead."""
    found = listed_chunks(spark, directory).collect()
    gone = sorted(r.file for r in found if not r.there)
    if strict and gone:
        raise FileNotFoundError(f"{len(gone)} listed chunks are missing or empty: {', '.join(gone[:5])}")
    base = directory.rstrip("/") + "/chunks/"
    paths = [base + r.file for r in found if r.there]
    if not paths:
        return spark.createDataFrame([], schema)
    with _few_listing_tasks(spark):
        return spark.read.schema(schema).option("multiLine", "true").json(paths)


def check_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    """Integrity problems of a published snapshot: manifest present, chunk list
    non-empty, every listed file present and non-empty. Empty result = valid."""
    manifest = read_manifest(spark, directory)
    whole = "manifest missing" if manifest is None else "" if manifest.get("chunks") else "no chunks listed"
    if whole:
        return spark.createDataFrame([(whole,)], "problem string")
    base = directory.rstrip("/") + "/chunks/"
    bad = [r.file for r in missing_chunks(spark, directory).collect()]  # none of a valid release
    return spark.createDataFrame([(("empty: " if exists(spark, base + f) else "missing: ") + f,) for f in sorted(bad)], "problem string")


def publish(df: DataFrame, releases_dir: str, release: str, keep: int = 3, tie: str | None = None,
            size: int = presets.CHUNK_SIZE, metadata: dict | None = None) -> tuple[dict, DataFrame]:
    """Write a new release directory (chunks, manifest, metadata), validate it, and
    only then switch the ``current`` pointer to it; prune to the ``keep`` newest
    releases, never the live one. Nothing is overwritten in place."""
    spark = df.sparkSession
    target = f"{releases_dir.rstrip('/')}/{release}"
    manifest = write_chunks(df, target, release, size=size, tie=tie)
    if metadata is not None:
        write_text(spark, f"{target}/metadata.json", json.dumps(metadata, indent=2))
    problems = check_snapshot(spark, target)
    if problems.isEmpty():
        write_text(spark, f"{releases_dir.rstrip('/')}/current", release)
        prune_releases(spark, releases_dir, keep, protect=release)
    return manifest, problems


def prune_releases(spark: SparkSession, releases_dir: str, keep: int, protect: str) -> list[str]:
    fs, p = _fs(spark, releases_dir)
    names = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()), reverse=True)
    doomed = [n for n in names[keep:] if n != protect]
    for n in doomed:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{releases_dir.rstrip('/')}/{n}"), True)
    return doomed
