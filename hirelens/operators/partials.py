"""Facet counts, totals and company estimates from stored partial aggregates, one set a part (a chunk, or a stream's epoch).

    <root>/w=<id>/part=<part>/*.parquet   facet, value, n, companies (HLL sketch), hours-old bins as facet ``minute``
    <root>/live.json                      part -> the folder that holds its partial

Counts add up and sketches unite, so a changed or new part is aggregated alone, and every total is an aggregate over
the partials: some facet values a part, whatever its rows. A part that comes again (a rebuilt chunk, a replayed epoch)
replaces its partial. Folders are written whole before the list names them; the list is replaced at once.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..sources.chunks import _fs, read_text, write_text
from .facets import REMOTE, UNKNOWN
from .search import as_timestamp, epoch_micros

SCHEMA = "facet string, value string, n long, companies binary"
#: Of the sketches: 2^12 registers, a standard error of about 1.6 %.
LOG_REGISTERS = 12
ALL, MATCHING, COUNTRY, MINUTE = "all", "matching", "country", "minute"
_MINUTE_US = 60_000_000


def partial(rows: DataFrame, part: Column, cols: tuple[str, ...] = ("ats", "skill_level"), matching: Column | None = None) -> DataFrame:
    """(part, facet, value, n, companies) of postings: all rows, those that match, each facet column's values (lower-cased, blanks
    skipped), countries as ``facets.facet_country`` counts them, and the minute of first_seen. One scan, one aggregate."""
    def pair(facet: str, value: Column, when: Column | None = None) -> Column:
        p = F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))
        return p if when is None else F.when(when, p)

    names = set(rows.columns)
    pairs = [pair(ALL, F.lit(""))]
    if matching is not None:
        pairs.append(pair(MATCHING, F.lit(""), F.coalesce(matching, F.lit(False))))
    for c in cols:
        value = F.lower(F.col(c))
        pairs.append(pair(c, value, blank_to_null(value).isNotNull()))
    if {"country", "remote"} <= names:
        pairs.append(pair(COUNTRY, F.coalesce(blank_to_null(F.col("country")), F.lit(UNKNOWN))))
        pairs.append(pair(COUNTRY, F.lit(REMOTE), F.coalesce(F.col("remote"), F.lit(False))))
    if "first_seen" in names:
        seen = F.unix_micros(as_timestamp(rows, "first_seen"))
        pairs.append(pair(MINUTE, F.floor(seen / _MINUTE_US), seen.isNotNull()))
    company = F.coalesce(blank_to_null(F.col("company_slug")), F.col("company")) if "company_slug" in names else F.col("company")
    flat = rows.select(part.cast("string").alias("part"), company.alias("company"), F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("p"))
    # minutes are many and need no sketch
    sketched = F.when(F.col("p.facet") != MINUTE, F.col("company"))
    return flat.groupBy("part", F.col("p.facet").alias("facet"), F.col("p.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(sketched, LOG_REGISTERS).alias("companies"))


def live(spark: SparkSession, root: str) -> dict[str, str]:
    """part -> folder, below the root."""
    text = read_text(spark, f"{root.rstrip('/')}/live.json")
    return json.loads(text) if text else {}


def _publish(spark: SparkSession, root: str, parts: dict[str, str]) -> None:
    """Name the live parts and delete what is named no more."""
    old = live(spark, root)
    write_text(spark, f"{root}/live.json", json.dumps(parts, sort_keys=True))
    fs, _ = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in set(old.values()) - set(parts.values()):
        fs.delete(path(f"{root}/{folder}"), True)


def put(spark: SparkSession, root: str, partials: DataFrame) -> list[str]:
    """Store the partials of some parts, in place of those they had. Returns the parts."""
    root = root.rstrip("/")
    folder = f"w={uuid.uuid4().hex}"
    partials.repartition("part").write.partitionBy("part").parquet(f"{root}/{folder}")
    written = spark.read.schema("part string").parquet(f"{root}/{folder}").select("part").distinct()
    parts = sorted(r.part for r in written.collect())  # as many as the write has parts
    _publish(spark, root, live(spark, root) | {p: f"{folder}/part={p}" for p in parts})
    return parts


def drop(spark: SparkSession, root: str, parts: list[str]) -> None:
    """Forget parts (chunks that a release no longer has)."""
    root = root.rstrip("/")
    _publish(spark, root, {p: f for p, f in live(spark, root).items() if p not in set(parts)})


def read(spark: SparkSession, root: str) -> DataFrame:
    """The partials of all live parts."""
    root = root.rstrip("/")
    folders = sorted(live(spark, root).values())
    return spark.read.schema(SCHEMA).parquet(*[f"{root}/{f}" for f in folders]) if folders else spark.createDataFrame([], SCHEMA)


def merged(partials: DataFrame) -> DataFrame:
    """Partials of several parts as one: counts added up, sketches united."""
    return partials.groupBy("facet", "value").agg(F.sum("n").alias("n"), F.hll_union_agg("companies").alias("companies"))


def compact(spark: SparkSession, root: str, parts: list[str], into: str) -> None:
    """Replace parts that won't come again by one, ``into``."""
    root = root.rstrip("/")
    own = live(spark, root)
    rows = spark.read.schema(SCHEMA).parquet(*[f"{root}/{own[p]}" for p in parts])
    folder = f"w={uuid.uuid4().hex}"
    merged(rows).write.parquet(f"{root}/{folder}/part={into}")
    _publish(spark, root, {p: f for p, f in own.items() if p not in set(parts)} | {into: f"{folder}/part={into}"})


def counts(partials: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    """(facet, value, n) of the named facets."""
    return partials.filter(F.col("facet").isin(*facets)).groupBy("facet", "value").agg(F.sum("n").alias("n"))


def companies(partials: DataFrame, facet: str = ALL) -> DataFrame:
    """(value, n, companies): rows and about how many distinct companies of each value."""
    own = merged(partials.filter(F.col("facet") == facet))
    return own.select("value", "n", F.hll_sketch_estimate("companies").alias("companies"))


def totals(partials: DataFrame, now: dt.datetime, rows: DataFrame | None = None, hours: int = 24) -> DataFrame:
    """total_jobs, matching, and fresh: rows first seen at most ``hours`` before ``now`` (future ones count). Whole minutes come from the partials; the
    minute that the cutoff divides is counted in ``rows``, which may be left out if it lies on a full minute."""
    cutoff = epoch_micros(now) - hours * 3_600_000_000
    first = -(-cutoff // _MINUTE_US)
    n = F.col("n")
    minute = F.when(F.col("facet") == MINUTE, F.col("value").cast("long"))

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")

    out = partials.agg(total(F.col("facet") == ALL).alias("total_jobs"), total(F.col("facet") == MATCHING).alias("matching"), total(minute >= first).alias("fresh"))
    if cutoff % _MINUTE_US == 0:
        return out
    if rows is None:
        raise ValueError("the cutoff divides a minute: give the rows")
    seen = F.unix_micros(as_timestamp(rows, "first_seen"))
    rest = rows.filter((seen >= cutoff) & (seen < first * _MINUTE_US)).agg(F.count(F.lit(1)).alias("__rest"))
    return out.crossJoin(rest).select("total_jobs", "matching", (F.col("fresh") + F.col("__rest")).alias("fresh"))  # one row each
