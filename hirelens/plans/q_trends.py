"""Registered queries: trend snapshot, log upsert/read, anomaly, health, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..functions.classify import is_recruiter, tier
from ..operators import trends as TR
from ..session import read_table
from ..sources import trends as TS
from . import fixtures as fx
from . import sqlgen as g
from .q_search import W, jobs
from .registry import register

RUN_DATE = fx.JOBS_NOW.date()


def _snap_sql(src: str, date_sql: str, company: str) -> str:
    parts = [f"SELECT {date_sql} AS date, 'total' AS dimension, 'total_jobs' AS key, count(*) AS n FROM {src}",
             f"SELECT {date_sql}, 'total', 'active_companies', count(DISTINCT {company}) FROM {src}",
             f"SELECT {date_sql}, 'total', 'recruiter_jobs', CAST(count_if(coalesce(is_recruiter, false)) AS BIGINT) FROM {src}"]
    parts += [f"SELECT {date_sql}, 'platform', {g.q(p.lower())}, CAST(count_if(ats = {g.q(p)}) AS BIGINT) FROM {src}"
              for p in presets.PLATFORMS]
    parts += [f"SELECT {date_sql}, 'tier', {g.q(t)}, CAST(count_if(skill_level = {g.q(t)}) AS BIGINT) FROM {src}" for t in presets.TIERS]
    return "\nUNION ALL ".join(parts)


@register("trend_snapshot", f"{W}\n" + _snap_sql("jobs_c", f"DATE '{RUN_DATE}'", "company_slug"))
def q_trend_snapshot(spark, sf):
    return TR.snapshot_long(TR.trend_snapshot(jobs(spark, sf), RUN_DATE))


_LOG = """per AS (SELECT CAST(ts AS DATE) AS date, event_type AS platform, count(*) AS value FROM events GROUP BY 1, 2),
dates AS (SELECT date, row_number() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) d),
lg AS (SELECT p.date, d.r, p.platform, p.value FROM per p JOIN dates d ON p.date = d.date)"""
# the status page walks a fixed list: one platform never reports, one misses every fourth day
HEALTH_PLATFORMS = ["click", "purchase", "signup", "view", "outage"]
_HEALTH = f"""{_LOG},
hl AS (SELECT d.date, d.r, k.platform, lg.value FROM dates d CROSS JOIN (SELECT unnest({HEALTH_PLATFORMS}) AS platform) k
 LEFT JOIN lg ON lg.date = d.date AND lg.platform = k.platform AND NOT (k.platform = 'purchase' AND day(d.date) % 4 = 0))"""
_WIN = f"(PARTITION BY platform ORDER BY r RANGE BETWEEN {presets.ANOMALY_LOOKBACK} PRECEDING AND 1 PRECEDING)"


def _log(spark, sf):
    return TR.daily_log(read_table(spark, sf, "events"))


def _health_log(spark, sf):
    missing = F.dayofmonth("date") % 4 == 0
    return _log(spark, sf).withColumn("by_platform", F.map_filter("by_platform", lambda k, v: ~((k == "purchase") & missing)))


@register("anomaly_zscore", f"""WITH {_LOG},
b AS (SELECT *, count(value) OVER {_WIN} AS n_prior, avg(value) OVER {_WIN} AS mean,
  stddev_pop(value) OVER {_WIN} AS sd FROM lg),
c AS (SELECT *, CASE WHEN sd > 0 THEN (value - mean) / sd END AS zs,
  CASE WHEN sd = 0 AND mean <> 0 THEN abs(value - mean) / mean END AS flat_dev FROM b
  WHERE r >= {presets.ANOMALY_MIN_DAYS + 1} AND n_prior >= {presets.ANOMALY_MIN_DAYS}),
d AS (SELECT *, CASE WHEN sd > 0 THEN abs(zs) > {presets.ANOMALY_Z} ELSE flat_dev > {presets.ANOMALY_FLAT_BAND} END AS flagged FROM c)
SELECT date, platform, value, n_prior, round(mean, 4) AS mean, round(sd, 4) AS stdev, round(zs, 4) AS z, flagged,
 CASE WHEN flagged IS NULL OR NOT flagged THEN NULL WHEN sd = 0 THEN 'FLAT' WHEN value > mean THEN 'SPIKE' ELSE 'DROP' END AS direction
FROM d""")
def q_anomaly(spark, sf):
    return TR.anomalies(_log(spark, sf))


@register("platform_health", f"""WITH {_HEALTH},
b AS (SELECT *, avg(value) OVER {_WIN} AS mean FROM hl),
c AS (SELECT *, CASE WHEN value IS NOT NULL AND mean <> 0 THEN value / mean * 100 END AS pct FROM b)
SELECT date, platform, value, round(mean, 4) AS mean, round(pct, 4) AS pct,
 CASE WHEN pct IS NULL THEN NULL WHEN pct < {presets.HEALTH_BLOCK_PCT} THEN 'possible block'
  WHEN pct < {presets.HEALTH_LOW_PCT} THEN 'below normal' ELSE '' END AS note FROM c""")
def q_platform_health(spark, sf):
    return TR.platform_health(_health_log(spark, sf), platforms=HEALTH_PLATFORMS)


@register("trend_history", f"""WITH t AS (SELECT CAST(ts AS DATE) AS date, count(*) AS total_jobs,
  count(DISTINCT user_id) AS active_companies FROM events GROUP BY 1 ORDER BY date DESC LIMIT {presets.HISTORY_ROWS})
SELECT date, total_jobs, active_companies, total_jobs - lag(total_jobs) OVER (ORDER BY date) AS change FROM t""")
def q_trend_history(spark, sf):
    return TR.history(_log(spark, sf))


def _event_jobs(spark, sf):
    ep = fx.event_postings(spark, sf)
    return ep.withColumn("skill_level", tier("title")).withColumn("is_recruiter", is_recruiter("company"))


@register("trend_upsert", f"""WITH {g.event_postings_cte()[:]},
epc AS (SELECT *, {g.tier('title')} AS skill_level, {g.is_recruiter('company')} AS is_recruiter
  FROM ep WHERE CAST(scraped_at AS DATE) = DATE '{fx.EVENTS_LAST_DAY}'),
snap AS ({_snap_sql('epc', f"DATE '{fx.EVENTS_LAST_DAY}'", 'company')}),
old AS (SELECT CAST(ts AS DATE) AS date, event_type AS platform, count(*) AS n FROM events
  WHERE CAST(ts AS DATE) <> DATE '{fx.EVENTS_LAST_DAY}' GROUP BY 1, 2),
oldt AS (SELECT CAST(ts AS DATE) AS date, count(*) AS total_jobs FROM events
  WHERE CAST(ts AS DATE) <> DATE '{fx.EVENTS_LAST_DAY}' GROUP BY 1)
SELECT o.date, t.total_jobs, o.platform, o.n FROM old o JOIN oldt t ON o.date = t.date
UNION ALL
SELECT s.date, (SELECT n FROM snap WHERE key = 'total_jobs') AS total_jobs, s.key AS platform, s.n FROM snap s
WHERE s.dimension = 'platform'""")
def q_trend_upsert(spark, sf):
    log = _log(spark, sf)
    ej = _event_jobs(spark, sf).filter(F.to_date("scraped_at") == F.lit(fx.EVENTS_LAST_DAY))
    snap = TR.trend_snapshot(ej, fx.EVENTS_LAST_DAY, company="company")
    up = TR.upsert_trend(log, snap)
    return up.select("date", "total_jobs", F.explode("by_platform").alias("platform", "n"))


@register("trend_log_read", f"""WITH {_LOG}
SELECT date, platform, value AS n FROM lg""")
def q_trend_log_read(spark, sf):
    """Write the events-derived log as JSON Lines to a fresh snapshot folder in
    the shared checkpoint dir, then read it back (torn lines dropped, last row
    per date wins by file position)."""
    path = TS.write_trends(_log(spark, sf), TS.new_snapshot_dir(spark, "trends"))
    log = TS.read_trends(spark, path)
    return log.select("date", F.explode("by_platform").alias("platform", "n"))


@register("anomaly_latest", f"""WITH {_LOG},
b AS (SELECT *, count(value) OVER {_WIN} AS n_prior, avg(value) OVER {_WIN} AS mean,
  stddev_pop(value) OVER {_WIN} AS sd FROM lg),
c AS (SELECT *, CASE WHEN sd > 0 THEN (value - mean) / sd END AS zs,
  CASE WHEN sd = 0 AND mean <> 0 THEN abs(value - mean) / mean END AS flat_dev FROM b
  WHERE r >= {presets.ANOMALY_MIN_DAYS + 1} AND n_prior >= {presets.ANOMALY_MIN_DAYS} AND r = (SELECT max(r) FROM dates)),
d AS (SELECT *, CASE WHEN sd > 0 THEN abs(zs) > {presets.ANOMALY_Z} ELSE flat_dev > {presets.ANOMALY_FLAT_BAND} END AS flagged FROM c)
SELECT date, platform, value, n_prior, round(mean, 4) AS mean, round(sd, 4) AS stdev, round(zs, 4) AS z, flagged,
 CASE WHEN flagged IS NULL OR NOT flagged THEN NULL WHEN sd = 0 THEN 'FLAT' WHEN value > mean THEN 'SPIKE' ELSE 'DROP' END AS direction
FROM d""")
def q_anomaly_latest(spark, sf):
    """The scheduled check: only the newest log row is judged."""
    return TR.anomalies(_log(spark, sf), latest_only=True)


@register("platform_health_latest", f"""WITH {_HEALTH},
b AS (SELECT *, avg(value) OVER {_WIN} AS mean FROM hl),
c AS (SELECT *, CASE WHEN value IS NOT NULL AND mean <> 0 THEN value / mean * 100 END AS pct FROM b
  WHERE r = (SELECT max(r) FROM dates))
SELECT date, platform, value, round(mean, 4) AS mean, round(pct, 4) AS pct,
 CASE WHEN pct IS NULL THEN NULL WHEN pct < {presets.HEALTH_BLOCK_PCT} THEN 'possible block'
  WHEN pct < {presets.HEALTH_LOW_PCT} THEN 'below normal' ELSE '' END AS note FROM c""")
def q_platform_health_latest(spark, sf):
    """The status page: the newest run against the up-to-7 runs before it."""
    log = _health_log(spark, sf)
    latest = log.agg(F.max("date").alias("date"))
    return TR.platform_health(log, platforms=HEALTH_PLATFORMS).join(latest, "date", "left_semi")
