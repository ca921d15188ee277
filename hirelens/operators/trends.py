"""Daily trend log: snapshot, upsert, anomaly z-scores, platform health, history.

The log holds one row per day (``date``, totals, ``by_platform`` map), so its
size is bounded by the number of days, not by the data. Baselines count *log
rows*, not calendar days: each date gets its row index ``r`` and a platform's
baseline is its values at rows r-7 … r-1 (a RANGE frame on ``r``), so a
platform absent on a day is skipped, never replaced by an older row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import presets


def trend_snapshot(jobs: DataFrame, run_date: dt.date | str, platforms=None, tiers=None,
                   total_jobs: int | None = None, ats="ats", level="skill_level",
                   company="company_slug", recruiter="is_recruiter") -> DataFrame:
    """One log row for ``run_date``: totals plus per-platform and per-tier counts
    over the FIXED domains with zero fill (platform keys lower-cased).
    A single global aggregate (partial combine per task), no shuffle by key."""
    platforms = platforms or presets.PLATFORMS
    tiers = tiers or presets.TIERS
    aggs = [F.count(F.lit(1)).alias("_rows"),
            F.count_distinct(F.col(company)).alias("active_companies"),
            F.count_if(F.coalesce(F.col(recruiter), F.lit(False))).alias("recruiter_jobs")]
    aggs += [F.count_if(F.col(ats) == p).alias(f"_p{i}") for i, p in enumerate(platforms)]
    aggs += [F.count_if(F.col(level) == t).alias(f"_t{i}") for i, t in enumerate(tiers)]
    row = jobs.agg(*aggs)
    by_platform = F.map_from_arrays(F.array(*[F.lit(p.lower()) for p in platforms]),
                                    F.array(*[F.col(f"_p{i}") for i in range(len(platforms))]))
    by_tier = F.map_from_arrays(F.array(*[F.lit(t) for t in tiers]),
                                F.array(*[F.col(f"_t{i}") for i in range(len(tiers))]))
    total = F.lit(total_jobs).cast("bigint") if total_jobs is not None else F.col("_rows")
    return row.select(F.to_date(F.lit(str(run_date))).alias("date"), total.alias("total_jobs"),
                      "active_companies", "recruiter_jobs", by_platform.alias("by_platform"),
                      by_tier.alias("by_tier"))


def snapshot_long(snap: DataFrame) -> DataFrame:
    """(date, dimension, key, n) view of log rows — totals, platforms, tiers."""
    totals = F.array(*[F.struct(F.lit("total").alias("dimension"), F.lit(c).alias("key"), F.col(c).cast("bigint").alias("n"))
                       for c in ("total_jobs", "active_companies", "recruiter_jobs")])
    plat = F.transform(F.map_entries("by_platform"),
                       lambda e: F.struct(F.lit("platform").alias("dimension"), e["key"].alias("key"), e["value"].alias("n")))
    tier = F.transform(F.map_entries("by_tier"),
                       lambda e: F.struct(F.lit("tier").alias("dimension"), e["key"].alias("key"), e["value"].alias("n")))
    return snap.select("date", F.inline(F.concat(totals, plat, tier)))


def daily_log(events: DataFrame, ts="ts", platform="event_type", entity="user_id") -> DataFrame:
    """A trend log from a scrape/event table: per day, total rows, distinct
    entities and a by_platform map of the platforms seen that day (no zero
    fill: an unseen platform is absent from that day's row)."""
    day = F.to_date(F.col(ts))
    per = events.groupBy(day.alias("date"), F.col(platform).alias("platform")).agg(F.count(F.lit(1)).alias("n"))
    tot = events.groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("total_jobs"),
                                                F.count_distinct(F.col(entity)).alias("active_companies"))
    maps = per.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("platform", "n"))).alias("by_platform"))
    return tot.join(maps, "date")


def upsert_trend(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Replace the log row(s) of the snapshot's date, keep the rest, by date."""
    kept = log.join(snapshot.select("date"), "date", "left_anti")
    return kept.unionByName(snapshot, allowMissingColumns=True)


def _indexed(log: DataFrame) -> DataFrame:
    """Row index per log date. The log is one row per day, so this ordered
    window is bounded by the number of days."""
    by_day = Window.orderBy("date")
    whole = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return log.withColumn("r", F.row_number().over(by_day)).withColumn("last", F.max("r").over(whole))


def _long(log: DataFrame) -> DataFrame:
    return _indexed(log).select("date", "r", "last", F.explode("by_platform").alias("platform", "value"))


def anomalies(log: DataFrame, lookback: int = presets.ANOMALY_LOOKBACK, z: float = presets.ANOMALY_Z,
              min_days: int = presets.ANOMALY_MIN_DAYS, flat_band: float = presets.ANOMALY_FLAT_BAND,
              latest_only: bool = False) -> DataFrame:
    """Per (date, platform in that day's row): value vs the platform's values in
    the ``lookback`` preceding log rows. Evaluated when the log has at least
    ``min_days + 1`` rows up to the date and the platform has at least
    ``min_days`` prior values. Population stdev; flagged when |z| > z, or for a
    flat history when |x - mean| / mean > flat_band (mean 0: no verdict)."""
    lg = _long(log)
    w = Window.partitionBy("platform").orderBy("r").rangeBetween(-lookback, -1)
    b = lg.select("date", "r", "last", "platform", "value",
                  F.count("value").over(w).alias("n_prior"),
                  F.avg("value").over(w).alias("mean"),
                  F.stddev_pop("value").over(w).alias("stdev"))
    b = b.filter((F.col("r") >= min_days + 1) & (F.col("n_prior") >= min_days))
    if latest_only:
        b = b.filter(F.col("r") == F.col("last"))
    zs = F.when(F.col("stdev") > 0, (F.col("value") - F.col("mean")) / F.col("stdev"))
    flat_dev = F.when((F.col("stdev") == 0) & (F.col("mean") != 0),
                      F.abs(F.col("value") - F.col("mean")) / F.col("mean"))
    flagged = F.when(F.col("stdev") > 0, F.abs(zs) > z).otherwise(flat_dev > flat_band)
    direction = (F.when(~flagged | flagged.isNull(), F.lit(None))
                 .when(F.col("stdev") == 0, "FLAT")
                 .when(F.col("value") > F.col("mean"), "SPIKE").otherwise("DROP"))
    return b.select("date", "platform", F.col("value").cast("bigint").alias("value"), "n_prior",
                    F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"),
                    F.round(zs, 4).alias("z"), flagged.alias("flagged"), direction.alias("direction"))


def platform_health(log: DataFrame, lookback: int = presets.ANOMALY_LOOKBACK,
                    platforms: list[str] | None = None) -> DataFrame:
    """Per (date, platform of the fixed list): value as % of the mean of up to
    ``lookback`` prior log rows (no minimum); < 50 'possible block', < 80 'below
    normal'. A platform that a day's row lacks has a row with a NULL value."""
    keys = platforms or [p.lower() for p in presets.PLATFORMS]
    lg = _indexed(log).select("date", "r", "by_platform", F.explode(F.array(*[F.lit(k) for k in keys])).alias("platform"))
    lg = lg.withColumn("value", F.try_element_at("by_platform", F.col("platform")))
    w = Window.partitionBy("platform").orderBy("r").rangeBetween(-lookback, -1)
    b = lg.select("date", "platform", "value", F.avg("value").over(w).alias("mean"))
    pct = F.when(F.col("value").isNotNull() & (F.col("mean") != 0), F.col("value") / F.col("mean") * 100)
    note = (F.when(pct < presets.HEALTH_BLOCK_PCT, "possible block")
            .when(pct < presets.HEALTH_LOW_PCT, "below normal").otherwise(F.lit("")))
    return b.select("date", "platform", F.col("value").cast("bigint").alias("value"),
                    F.round("mean", 4).alias("mean"), F.round(pct, 4).alias("pct"),
                    F.when(pct.isNotNull(), note).alias("note"))


def history(log: DataFrame, n: int = presets.HISTORY_ROWS) -> DataFrame:
    """The last ``n`` log rows, newest first, with the change in total_jobs vs
    the previous shown row; the oldest shown row has no change."""
    last = log.orderBy(F.col("date").desc()).limit(n)
    w = Window.orderBy("date")  # at most n rows
    return (last.select("date", "total_jobs", "active_companies",
                        (F.col("total_jobs") - F.lag("total_jobs").over(w)).alias("change"))
            .orderBy(F.col("date").desc()))
