"""Run statistics and data-quality audits: per-platform fetch stats, active and
dead companies, run metadata, field coverage, date-format audit, link health.
All are grouped aggregates (map-side combined) over distributed tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.text import blank_to_null

DEAD = presets.DEAD_STATUSES


def live_companies(companies: DataFrame, dead: DataFrame) -> DataFrame:
    """Tracked companies minus the known-dead ones (anti join on platform, slug)."""
    return companies.join(dead.select("platform", "slug"), ["platform", "slug"], "left_anti")


def active_companies(jobs: DataFrame, slug: str = "slug") -> DataFrame:
    """(platform, slug, jobs) for every company that returned postings."""
    return jobs.groupBy(F.col("ats").alias("platform"), F.col(slug).alias("slug")).agg(
        F.count(F.lit(1)).alias("jobs"))


def fetch_stats(checked: DataFrame, statuses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per platform: companies checked, with postings, failed/empty, newly dead
    (no postings and 404/410), total postings.
    ``checked``: (platform, slug) fetched this run; ``statuses``: (platform,
    slug, status); ``jobs``: normalised postings with ``ats`` and ``slug``."""
    per = active_companies(jobs)
    s = (checked.select("platform", "slug")
         .join(statuses.select("platform", "slug", "status"), ["platform", "slug"], "left")
         .join(per, ["platform", "slug"], "left"))
    has = F.coalesce(F.col("jobs"), F.lit(0)) > 0
    return s.groupBy("platform").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(has).alias("with_jobs"),
        F.count_if(~has).alias("failed"),
        F.count_if(~has & F.col("status").isin(DEAD)).alias("newly_dead"),
        F.coalesce(F.sum("jobs"), F.lit(0)).cast("bigint").alias("total_jobs"))


def update_dead(dead: DataFrame, checked: DataFrame, statuses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Old dead set ∪ companies that returned nothing with a 404/410 (distinct)."""
    with_jobs = jobs.select(F.col("ats").alias("platform"), "slug").distinct()
    new_dead = (checked.select("platform", "slug")
                .join(statuses.filter(F.col("status").isin(DEAD)).select("platform", "slug"), ["platform", "slug"])
                .join(with_jobs, ["platform", "slug"], "left_anti"))
    return dead.select("platform", "slug").union(new_dead).distinct()


def all_companies(companies: DataFrame) -> DataFrame:
    """The run's companies, known-dead ones included, distinct by slug, sorted."""
    return companies.select("slug").distinct().orderBy("slug")


def run_metadata(companies: DataFrame, fetched: DataFrame, kept: DataFrame, now: dt.datetime,
                 source: str = "automated") -> DataFrame:
    """One row: companies of the run (known-dead ones included, distinct by slug),
    companies that returned postings, postings kept by the clean step, recruiter
    postings among them, source, platforms, time.
    The three inputs are tagged and reduced in ONE aggregate (no join)."""
    u = (companies.select(F.lit(0).alias("_t"), F.lit(None).cast("string").alias("ats"),
                        F.col("slug"), F.lit(None).cast("boolean").alias("rec"))
         .unionByName(fetched.select(F.lit(1).alias("_t"), "ats", "slug", F.lit(None).cast("boolean").alias("rec")))
         .unionByName(kept.select(F.lit(2).alias("_t"), F.lit(None).cast("string").alias("ats"),
                                  F.lit(None).cast("string").alias("slug"),
                                  F.coalesce(F.col("is_recruiter"), F.lit(False)).alias("rec"))))
    return u.agg(F.count_distinct(F.when(F.col("_t") == 0, F.col("slug"))).alias("total_companies"),
                 F.count_distinct(F.when(F.col("_t") == 1, F.struct("ats", "slug"))).alias("active_companies"),
                 F.count_if(F.col("_t") == 2).alias("total_jobs"),
                 F.count_if((F.col("_t") == 2) & F.col("rec")).alias("recruiter_jobs"),
                 F.lit(source).alias("source_type"), F.lit(presets.PLATFORM_SOURCES).alias("platforms"),
                 F.lit(now.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("last_updated"))


def coverage(jobs: DataFrame, by: str = "ats", col: str = "updated_at") -> DataFrame:
    """Count by (platform or 'UNKNOWN', field present and non-empty)."""
    present = blank_to_null(F.col(col).cast("string")).isNotNull()
    return jobs.groupBy(F.coalesce(F.col(by), F.lit("UNKNOWN")).alias(by), present.alias(f"has_{col}")) \
        .agg(F.count(F.lit(1)).alias("n"))


def date_audit(jobs: DataFrame, must_have: dict[str, bool], col: str = "updated_at") -> DataFrame:
    """Per audited platform: postings with a date, postings, verdict —
    NO_JOBS / BAD_FORMAT / MISSING (required but none) / NONE / OK."""
    raw = blank_to_null(F.col(col).cast("string"))
    parsed = F.regexp_replace(raw, "Z$", "+00:00").try_cast("timestamp")
    per = jobs.groupBy(F.col("ats").alias("platform")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(raw.isNotNull()).alias("with_date"),
        F.min(F.when(raw.isNotNull() & parsed.isNull(), raw)).alias("bad_example"))
    dom = jobs.sparkSession.createDataFrame([(k, v) for k, v in must_have.items()], "platform string, must boolean")
    a = dom.join(per, "platform", "left")
    verdict = (F.when(F.coalesce(F.col("total"), F.lit(0)) == 0, "NO_JOBS")
               .when(F.col("bad_example").isNotNull(), "BAD_FORMAT")
               .when((F.col("with_date") == 0) & F.col("must"), "MISSING")
               .when(F.col("with_date") == 0, "NONE")
               .otherwise("OK"))
    return a.select("platform", F.coalesce("with_date", F.lit(0)).alias("with_date"),
                    F.coalesce("total", F.lit(0)).alias("total"), verdict.alias("verdict"), "bad_example")


def url_health(checked: DataFrame, platforms=None) -> DataFrame:
    """Link check verdict per platform from (platform, url, alive):
    PATTERN_BROKEN (none alive), DEGRADED (< 50 % alive), OK, NO_URLS."""
    platforms = platforms or presets.PLATFORMS
    per = checked.groupBy("platform").agg(F.count(F.lit(1)).alias("total"),
                                          F.count_if(F.coalesce(F.col("alive"), F.lit(False))).alias("alive"))
    dom = checked.sparkSession.createDataFrame([(p,) for p in platforms], "platform string")
    a = dom.join(per, "platform", "left")
    total, alive = F.coalesce("total", F.lit(0)), F.coalesce("alive", F.lit(0))
    verdict = (F.when(total == 0, "NO_URLS").when(alive == 0, "PATTERN_BROKEN")
               .when(alive < total * 0.5, "DEGRADED").otherwise("OK"))
    return a.select("platform", alive.alias("alive"), total.alias("total"), verdict.alias("verdict"))
