"""Registered streaming queries. Weekly scrape runs (derived from events) land
in an incoming folder one run at a time; after each arrival the stream is
triggered with availableNow and resumes from its checkpoint, as a scheduled
job would. Results are read back from the sinks' files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import presets
from ..operators import bucket_merge as BM
from ..operators import partials as PA
from ..sources.trends import new_snapshot_dir
from ..streaming import streams as ST
from ..streaming import timers as TM
from . import fixtures as fx
from . import sqlgen as g
from .registry import register

RUN_SCHEMA = "seq long, ats string, company string, url string, id string, title string, scraped_at timestamp_ntz, key string"


def _feed(spark, sf, on_arrival):
    """Append each weekly run to the incoming folder, then call ``on_arrival``."""
    base = new_snapshot_dir(spark, "stream")
    incoming = f"{base}/incoming"
    runs = fx.scrape_runs(spark, sf)
    run_ids = sorted(r["run"] for r in runs.select("run").distinct().collect())  # a handful of weeks
    for r in run_ids:
        runs.filter(F.col("run") == r).drop("run").write.mode("append").parquet(incoming)
        on_arrival(base, incoming)
    return base


def _source(spark, incoming):
    return spark.readStream.schema(RUN_SCHEMA).parquet(incoming)


_RUN = f"CAST(floor(date_diff('day', DATE '2024-01-01', CAST(scraped_at AS DATE)) / {fx.RUN_DAYS}) AS INT)"
_FIRST_SEEN_SQL = f"""{"WITH " + g.event_postings_cte()},
runs AS (SELECT * EXCLUDE (first_seen), {_RUN} AS run FROM ep WHERE key <> ''),
firstrun AS (SELECT key, min(run) AS run FROM runs GROUP BY key),
fs AS (SELECT r.key, arg_max(r.scraped_at, r.seq) AS first_seen FROM runs r JOIN firstrun f ON r.key = f.key AND r.run = f.run
  GROUP BY r.key),
last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM runs) t WHERE rn = 1)"""


_STREAM_MERGE_SQL = f"""{_FIRST_SEEN_SQL}
SELECT l.key, l.seq, l.ats, l.company, l.url, l.id, l.title, l.scraped_at, f.first_seen FROM last l JOIN fs f ON l.key = f.key"""
_MERGED = ["key", "seq", "ats", "company", "url", "id", "title", "scraped_at", "first_seen"]


@register("stream_merge", _STREAM_MERGE_SQL)
def q_stream_merge(spark, sf):
    """Onto a bucketed dataset: each run rewrites the buckets that it meets."""
    def arrive(base, incoming):
        ST.start_bucket_merge_stream(_source(spark, incoming), f"{base}/table", f"{base}/ckpt-merge", fx.STREAM_NOW,
                                     buckets=16, locality=BM.company_of).awaitTermination()
    base = _feed(spark, sf, arrive)
    return BM.read(spark, f"{base}/table").select(*_MERGED)


@register("stream_merge_snapshots", _STREAM_MERGE_SQL)
def q_stream_merge_snapshots(spark, sf):
    """Onto whole snapshots."""
    def arrive(base, incoming):
        ST.start_merge_stream(_source(spark, incoming), f"{base}/snapshots", f"{base}/ckpt-merge",
                              fx.STREAM_NOW).awaitTermination()
    base = _feed(spark, sf, arrive)
    snap = ST.current_snapshot(spark, f"{base}/snapshots")
    return spark.read.parquet(snap).select(*_MERGED)


@register("stream_first_seen", f"{_FIRST_SEEN_SQL}\nSELECT key, first_seen FROM fs")
def q_stream_first_seen(spark, sf):
    def arrive(base, incoming):
        ST.run_to_files(ST.first_seen_stream(_source(spark, incoming)), f"{base}/first_seen", f"{base}/ckpt-fs")
    base = _feed(spark, sf, arrive)
    out = spark.read.parquet(f"{base}/first_seen")
    return out.select("key", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"))


TTL_DAYS = 4  # short beside the log's 30 days, so that many postings are forgotten and found again
_VISITS_SQL = f"""{"WITH " + g.event_postings_cte()},
visit AS (SELECT key, {_RUN} AS run, min(scraped_at) AS earliest, max(scraped_at) AS latest, arg_max(scraped_at, seq) AS last, max(seq) AS seq
 FROM ep WHERE key <> '' GROUP BY 1, 2),
seen AS (SELECT *, max(latest) OVER (PARTITION BY key ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM visit)"""


def _timed(spark, sf):
    def arrive(base, incoming):
        ST.run_to_files(TM.sightings(_source(spark, incoming), dt.timedelta(days=TTL_DAYS)), f"{base}/sightings", f"{base}/ckpt-timers")
    return _feed(spark, sf, arrive)


@register("stream_first_seen_timers", f"""{_VISITS_SQL}
SELECT key, last AS first_seen, seq FROM seen
WHERE before IS NULL OR epoch_ms(earliest) >= epoch_ms(before) + {TTL_DAYS * 86_400_000}""")
def q_stream_first_seen_timers(spark, sf):
    """A posting not sighted for four days is forgotten; its next sighting counts as new. One sighted in time is renewed."""
    out = spark.read.parquet(f"{_timed(spark, sf)}/sightings")
    return out.select("key", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), "seq")


@register("stream_first_seen_state", f"""{_VISITS_SQL}
SELECT key, max(latest) AS latest FROM seen GROUP BY key
HAVING epoch_ms(max(latest)) + {TTL_DAYS * 86_400_000} >= (SELECT epoch_ms(max(scraped_at)) - 86400000 FROM ep WHERE key <> '')""")
def q_stream_first_seen_state(spark, sf):
    """The keys that the state holds after the last run: those whose timer the watermark (latest sighting - 1 day) hasn't passed."""
    held = TM.held_keys(spark, f"{_timed(spark, sf)}/ckpt-timers")
    return held.select("key", F.col("latest").cast("timestamp_ntz").alias("latest"))


@register("stream_daily_counts", f"""{"WITH " + g.event_postings_cte()},
wm AS (SELECT max(scraped_at) - INTERVAL 1 DAY AS w FROM ep)
SELECT CAST(scraped_at AS DATE) AS day, ats AS platform, count(*) AS n FROM ep
WHERE CAST(scraped_at AS DATE) + INTERVAL 1 DAY <= (SELECT w FROM wm) GROUP BY 1, 2""")
def q_stream_daily_counts(spark, sf):
    """Append mode: only days whose window the watermark (latest event - 1 day)
    has passed are emitted; the open days are held back."""
    def arrive(base, incoming):
        ST.run_to_files(ST.daily_counts_stream(_source(spark, incoming)), f"{base}/daily", f"{base}/ckpt-daily")
    base = _feed(spark, sf, arrive)
    return spark.read.parquet(f"{base}/daily").select("day", "platform", "n")


_FACETS_SQL = f"""{"WITH " + g.event_postings_cte()},
epc AS (SELECT *, {g.tier('title')} AS skill_level FROM ep)
SELECT 'ats' AS facet, lower(ats) AS value, count(*) AS n FROM epc WHERE nullif(lower(ats), '') IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'skill_level' AS facet, lower(skill_level) AS value, count(*) AS n FROM epc
WHERE nullif(lower(skill_level), '') IS NOT NULL GROUP BY 2"""


@register("stream_facets", _FACETS_SQL)
def q_stream_facets(spark, sf):
    """From partial aggregates, one a run; the older of them folded."""
    from ..functions.classify import tier

    def arrive(base, incoming):
        src = _source(spark, incoming).withColumn("skill_level", tier("title"))
        ST.start_partial_stream(src, f"{base}/partials", f"{base}/ckpt-partials", fold=2).awaitTermination()
    base = _feed(spark, sf, arrive)
    return PA.counts(PA.read(spark, f"{base}/partials"), ("ats", "skill_level"))


@register("stream_facets_complete", _FACETS_SQL)
def q_stream_facets_complete(spark, sf):
    """By a stream in complete mode."""
    from ..functions.classify import tier

    def arrive(base, incoming):
        src = _source(spark, incoming).withColumn("skill_level", tier("title"))
        ST.start_facet_stream(src, f"{base}/facets", f"{base}/ckpt-facets").awaitTermination()
    base = _feed(spark, sf, arrive)
    return spark.read.parquet(ST.current_snapshot(spark, f"{base}/facets")).select("facet", "value", "n")
