"""Facet counts, dataset stats, map heat buckets and marker sampling.

Every aggregate is a hash aggregate with map-side partial combine; nothing is
collected or looped over on the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.labels import js_number_string, stable_jitter
from ..functions.text import blank_to_null
from .search import as_timestamp, epoch_micros

REMOTE = "__remote__"
UNKNOWN = "__unknown__"


def facet_country(df: DataFrame, country="country", remote="remote") -> DataFrame:
    """(value, n): jobs per country code, plus '__unknown__' (no code) and
    '__remote__' (remote flag set; those rows are also counted under their
    country). One scan: the remote total is folded out of the per-code groups."""
    code = F.coalesce(blank_to_null(F.col(country)), F.lit(UNKNOWN))
    per_code = df.groupBy(code.alias("value")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col(remote), F.lit(False))).alias("_r"))
    remote_row = per_code.agg(F.lit(REMOTE).alias("value"), F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("n"))
    return per_code.select("value", "n").unionByName(remote_row)


def facet_counts(df: DataFrame, cols=("ats", "skill_level")) -> DataFrame:
    """(facet, value, n) for each facet column, lower-cased, blanks skipped.
    One scan: each row is fanned out to one (facet, value) pair per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.lower(F.col(c)).alias("value")) for c in cols])
    return (df.select(F.inline(pairs))
            .filter(blank_to_null(F.col("value")).isNotNull())
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))


def stats(df: DataFrame, now: dt.datetime, approx: bool = False, matching: Column | None = None) -> DataFrame:
    """One row: total jobs, distinct companies (slug, else company), jobs first
    seen within 24 h of ``now`` (future timestamps count as fresh), and — given a
    search predicate — the matching count, all in one aggregate pass."""
    company = F.coalesce(blank_to_null(F.col("company_slug")), F.col("company"))
    fs = as_timestamp(df, "first_seen")
    cutoff = epoch_micros(now) - 24 * 3_600_000_000
    distinct = F.approx_count_distinct(company) if approx else F.count_distinct(company)
    aggs = [F.count(F.lit(1)).alias("total_jobs"), distinct.alias("companies"),
            F.count_if(F.unix_micros(fs) >= F.lit(cutoff)).alias("fresh_24h")]
    if matching is not None:
        aggs.append(F.count_if(matching).alias("matching"))
    return df.agg(*aggs)


def heat_buckets(df: DataFrame, min_count: int = presets.HEAT_MIN_COUNT, lat="lat", lng="lng",
                 jitter: bool = False) -> DataFrame:
    """(lat, lng, n) per exact coordinate pair, kept when n >= min_count;
    optionally the stable display jitter of the 'lat,lng' key."""
    b = (df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
         .groupBy(F.col(lat).alias("lat"), F.col(lng).alias("lng"))
         .agg(F.count(F.lit(1)).alias("n"))
         .filter(F.col("n") >= min_count))
    if not jitter:
        return b
    key = F.concat_ws(",", js_number_string("lat"), js_number_string("lng"))
    j = stable_jitter(key)
    return b.select("lat", "lng", "n", (F.col("lat") + j["dlat"]).alias("heat_lat"),
                    (F.col("lng") + j["dlng"]).alias("heat_lng"))


def marker_sample(df: DataFrame, box: tuple[float, float, float, float] | None = None,
                  k: int = presets.MARKER_LIMIT, order: str = "job_id",
                  cols=("job_id", "company", "title", "lat", "lng", "salary_median")) -> DataFrame:
    """Map markers: rows with coordinates inside ``box`` = (south, west, north,
    east), a 'real' company name (not all digits, not >= 8 hex chars), the first
    row (by ``order``) per company initial, the first ``k`` initials; salaried
    rows first. First-per-initial is a min_by hash aggregate (partial combine,
    no skewed window partition)."""
    company = F.col("company")
    real = company.isNotNull() & (company != "") & ~company.rlike(r"^\d+$") & ~company.rlike(r"(?i)^[a-f0-9]{8,}$")
    cond = F.col("lat").isNotNull() & F.col("lng").isNotNull() & real
    if box is not None:
        s, w, n, e = box
        cond = cond & F.col("lat").between(s, n) & F.col("lng").between(w, e)
    firsts = (df.filter(cond)
              .groupBy(F.lower(F.substring(company, 1, 1)).alias("initial"))
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("m")))
    top = firsts.select("initial", "m.*").orderBy(F.col(order)).limit(k)
    has_salary = F.coalesce(F.col("salary_median") != 0, F.lit(False))
    return top.withColumn("salaried", has_salary).orderBy(F.col("salaried").desc(), F.col(order))
