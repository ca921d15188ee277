"""Faceted search over a postings DataFrame: one FilterSpec becomes one boolean
Column (a single WHERE that Catalyst pushes toward the scan), plus sorting,
paging and the seven quick presets.

Nothing here reads the clock: ``now`` is always a parameter.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from . import order_index
from ..functions.classify import is_recruiter, role_match, tier_of_score, tier_score
from ..functions.text import any_contains, blank_to_null, fuzzy_match, split_terms, strip_ws, word_match

REMOTE = "__remote__"
UNKNOWN = "__unknown__"


@dataclasses.dataclass(frozen=True)
class FilterSpec:
    """Every search control. Defaults = the cleared form (recruiters hidden)."""
    hide_recruiters: bool = True
    remote_only: bool = False
    hide_applied: bool = False
    title: str = ""
    company: str = ""
    location: str = ""
    salary_min: int = 0
    salary_max: int = 0
    has_salary: bool = False
    status: str = ""
    ats: str = ""
    skill_level: str = ""
    posted_days: int | None = None
    fresh_hours: float | None = None
    role_preset: bool = False
    country: str = ""
    include_unknown_country: bool = False
    exclude: str = ""
    include: str = ""


def epoch_micros(value: dt.datetime) -> int:
    """Microseconds since the epoch of a naive-UTC (or aware) datetime."""
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return (value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Column as TIMESTAMP (UTC session): strings are parsed leniently (bad ->
    NULL), NTZ values are taken as UTC."""
    c = F.col(name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return blank_to_null(c).try_cast("timestamp")
    return c.cast("timestamp")


def age_micros(ts: Column, now: dt.datetime) -> Column:
    return F.lit(epoch_micros(now)) - F.unix_micros(ts)


def salary_median(df: DataFrame) -> Column:
    if "salary" in df.columns and isinstance(df.schema["salary"].dataType, T.StructType):
        return F.col("salary.median")
    return F.col("salary_median")


def classify_jobs(df: DataFrame, title="title", slug="company_slug", company="company") -> DataFrame:
    """Add ``skill_level`` (tier of the title) and ``is_recruiter`` (recruiter
    terms in the slug, falling back to the company) where missing."""
    out = df
    if "skill_level" not in df.columns:
        # score as its own column, then bucket: both stay in whole-stage codegen
        out = out.withColumn("_tier_score", tier_score(title)) \
            .withColumn("skill_level", tier_of_score(F.col("_tier_score"))).drop("_tier_score")
    if "is_recruiter" not in df.columns:
        out = out.withColumn("is_recruiter", is_recruiter(F.coalesce(blank_to_null(F.col(slug)), F.col(company))))
    return out


def _set_of(text: str) -> list[str]:
    return sorted({t.strip().lower() for t in (text or "").split(",") if t.strip()})


def country_predicate(selected: str, include_unknown: bool = False,
                      country="country", remote="remote") -> Column:
    if not selected:
        return F.lit(True)
    no_country = blank_to_null(F.col(country)).isNull()
    if selected == REMOTE:
        return F.coalesce(F.col(remote), F.lit(False))
    if selected == UNKNOWN:
        return no_country
    hit = F.coalesce(F.col(country) == F.lit(selected), F.lit(False))
    return (hit | no_country) if include_unknown else hit


def fresh_predicate(df: DataFrame, hours: float, now: dt.datetime, col="first_seen") -> Column:
    """first_seen parseable and at most ``hours`` old (future rows pass)."""
    ts = as_timestamp(df, col)
    return ts.isNotNull() & (age_micros(ts, now) <= F.lit(float(hours) * 3_600_000_000))


def posted_predicate(df: DataFrame, days: int, now: dt.datetime) -> Column:
    """updated_at, else first_seen — raw value chosen first, then parsed: a bad
    updated_at does not fall back to first_seen."""
    ts = posted_ts(df)
    return ts.isNotNull() & (age_micros(ts, now) <= F.lit(float(days) * 86_400_000_000))


def posted_ts(df: DataFrame) -> Column:
    up, fs = df.schema["updated_at"].dataType, df.schema["first_seen"].dataType
    if isinstance(up, T.StringType) or isinstance(fs, T.StringType):
        raw = F.coalesce(blank_to_null(F.col("updated_at").cast("string")),
                         blank_to_null(F.col("first_seen").cast("string")))
        return raw.try_cast("timestamp")
    return F.coalesce(F.col("updated_at"), F.col("first_seen")).cast("timestamp")


def predicate(df: DataFrame, spec: FilterSpec, now: dt.datetime, role=None,
              status_col: str | None = None) -> Column:
    """AND of all active controls, cheapest first (regex and levenshtein last)."""
    conds: list[Column] = []
    if spec.hide_recruiters:
        conds.append(~F.coalesce(F.col("is_recruiter"), F.lit(False)))
    if status_col is not None:
        st = F.coalesce(F.col(status_col), F.lit(""))
        if spec.hide_applied:
            conds.append(~st.isin("applied", "ignored"))
        if spec.status:
            conds.append(st == F.lit(spec.status))
    med = salary_median(df)
    if spec.has_salary:
        conds.append(med.isNotNull())
    lo, hi = int(spec.salary_min or 0), int(spec.salary_max or 0)
    if lo > 0 or hi > 0:
        conds.append(med.isNotNull())
        if lo > 0:
            conds.append(med >= lo)
        if hi > 0:
            conds.append(med <= hi)
    if spec.remote_only:
        loc_remote = F.lower(F.coalesce(F.col("location"), F.lit(""))).contains("remote")
        if "workplaceType" in df.columns:
            loc_remote = loc_remote | (F.lower(F.col("workplaceType")) == "remote")
        conds.append(F.coalesce(loc_remote, F.lit(False)))
    ats_set, level_set = _set_of(spec.ats), _set_of(spec.skill_level)
    if ats_set:
        conds.append(F.lower(F.coalesce(F.col("ats"), F.lit(""))).isin(ats_set))
    if spec.country:
        conds.append(country_predicate(spec.country, spec.include_unknown_country))
    if spec.fresh_hours is not None:
        conds.append(fresh_predicate(df, spec.fresh_hours, now))
    if spec.posted_days is not None:
        conds.append(posted_predicate(df, spec.posted_days, now))
    # skill_level is usually derived from the title by regex: test it after the
    # cheap comparisons so the regexes only run on rows that survived them
    if level_set:
        conds.append(F.lower(F.coalesce(F.col("skill_level"), F.lit(""))).isin(level_set))
    if spec.role_preset:
        conds.append(role_match("title", "skill_level", role))
    title_l = F.lower(F.coalesce(F.col("title"), F.lit("")))
    excl, incl = split_terms(spec.exclude.lower()), split_terms(spec.include.lower())
    if excl:
        conds.append(~any_contains(title_l, excl))
    if incl:
        conds.append(any_contains(title_l, incl))
    if spec.title.strip():
        conds.append(word_match("title", spec.title))
    if spec.company.strip():
        conds.append(word_match(F.coalesce(blank_to_null(F.col("company")), F.col("company_slug")), spec.company))
    if spec.location.strip():
        conds.append(fuzzy_match("location", spec.location.strip().lower(), presets.FUZZY_THRESHOLD))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def search(df: DataFrame, spec: FilterSpec, now: dt.datetime, status: DataFrame | None = None,
           role=None) -> DataFrame:
    """Filter postings by a FilterSpec. ``status`` = DataFrame(url, status, …);
    joined (left, on url) only when a status control is active."""
    needs_status = status is not None and (spec.hide_applied or bool(spec.status))
    base = df
    status_col = None
    if needs_status:
        s = status.select(F.col("url").alias("_st_url"), F.col("status").alias("_status"))
        base = df.join(s, df["url"] == s["_st_url"], "left").drop("_st_url")
        status_col = "_status"
    elif spec.status:
        # no status table: every job has status '' -> a status filter keeps nothing
        base = df.withColumn("_status", F.lit(None).cast("string"))
        status_col = "_status"
    out = base.filter(predicate(base, spec, now, role, status_col))
    return out.drop("_status") if status_col else out


# ---------------------------------------------------------------- sorting ---

#: A page within so many rows of either end is a top-k; beyond, the order is numbered.
DEEP_ROWS = 100_000


def sort_value(df: DataFrame, key: str) -> Column:
    if key == "salary":
        return salary_median(df)
    if key == "first_seen":
        return as_timestamp(df, "first_seen")
    if key == "posted":
        return posted_ts(df)
    if key == "company":
        raw = F.coalesce(blank_to_null(F.col("company")), F.col("company_slug"))
    else:
        raw = F.col(key).cast("string")
    return F.nullif(F.lower(strip_ws(F.coalesce(raw, F.lit("")))), F.lit(""))


def sort_columns(df: DataFrame, key: str, direction: str = "asc", tie: str | None = "job_id",
                 backwards: bool = False) -> list[Column]:
    """Nulls (and blank text) last in both directions; explicit tie-break.
    ``backwards``: the same order from its end."""
    v = sort_value(df, key)
    if backwards:
        cols = [v.desc_nulls_first() if direction == "asc" else v.asc_nulls_first()]
        return cols + ([F.col(tie).desc()] if tie and tie in df.columns else [])
    cols = [v.asc_nulls_last() if direction == "asc" else v.desc_nulls_last()]
    if tie and tie in df.columns:
        cols.append(F.col(tie).asc())
    return cols


def sort_jobs(df: DataFrame, key: str, direction: str = "asc", tie: str | None = "job_id") -> DataFrame:
    return df.orderBy(*sort_columns(df, key, direction, tie))


def clamp_page(n_rows: int, page_no: int, per_page: int) -> int:
    pages = max(1, math.ceil(n_rows / per_page))
    return min(max(1, int(page_no)), pages)


def page(df: DataFrame, key: str, direction: str, page_no: int, per_page: int = 25,
         tie: str | None = "job_id", n_rows: int | None = None) -> DataFrame:
    """Page ``page_no`` (clamped to the last page) of the sorted rows. The first page is one pass,
    a top-k; later ones count first, since they may lie past the end."""
    if per_page not in presets.PAGE_SIZES:
        raise ValueError(f"per_page must be one of {presets.PAGE_SIZES}")
    if page_no <= 1:
        return sort_jobs(df, key, direction, tie).limit(per_page)
    if n_rows is None:
        n_rows = df.count()
    p = clamp_page(n_rows, page_no, per_page)
    return sorted_rows(df, key, direction, (p - 1) * per_page, per_page, n_rows, tie)


def sorted_rows(df: DataFrame, key: str, direction: str, start: int, n: int, n_rows: int,
                tie: str | None = "job_id") -> DataFrame:
    """Rows [start, start + n) of the sorted ``n_rows`` rows. Near either end: a
    top-k (TakeOrderedAndProject) from that end, so a task keeps few rows. Further
    in: an order index, of which only the folders that hold the page are read."""
    n = max(0, min(n, n_rows - start))
    after = n_rows - start - n
    if start <= min(after, DEEP_ROWS):
        return sort_jobs(df, key, direction, tie).offset(start).limit(n)
    if after <= DEEP_ROWS:
        tail = df.orderBy(*sort_columns(df, key, direction, tie, backwards=True)).offset(after).limit(n)
        return sort_jobs(tail, key, direction, tie)
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = order_index.build(df, sort_columns(df, key, direction, tie), parts)
    return index.seek(start, n).orderBy(order_index.NUMBER).drop(order_index.NUMBER)


def new_matching(df: DataFrame, now: dt.datetime, hours: float = 24, k: int = presets.NEW_MATCHING_LIMIT,
                 role=None) -> DataFrame:
    """Role-preset matches first seen within ``hours`` of ``now``, newest first, top k."""
    fs = as_timestamp(df, "first_seen")
    hits = df.filter(fresh_predicate(df, hours, now) & role_match("title", "skill_level", role))
    return (hits.withColumn("age_hours", F.round(age_micros(fs, now) / F.lit(3_600_000_000.0), 4))
            .orderBy(F.col("first_seen").desc(), F.col("job_id").asc())
            .limit(k))


# ---------------------------------------------------------------- presets ---

def preset(name: str, df: DataFrame | None = None, role=None,
           fresh_hours: float = 24) -> tuple[FilterSpec, tuple[str, str] | None]:
    """Quick presets: clear to defaults, set the named controls, maybe a sort.
    The preferred country applies only if some row carries it (one cheap probe)."""
    role = role or presets.ROLE_PRESET

    def preferred() -> str:
        want = role.get("preferred_country") or ""
        if want and df is not None and not df.filter(F.col("country") == want).isEmpty():
            return want
        return ""

    if name == "new-for-me":
        return FilterSpec(role_preset=True, fresh_hours=fresh_hours, hide_applied=True, country=preferred()), ("first_seen", "desc")
    if name == "my-roles":
        return FilterSpec(role_preset=True, country=preferred()), None
    if name == "remote":
        return FilterSpec(remote_only=True), None
    if name == "entry":
        return FilterSpec(skill_level="entry"), None
    if name == "has-salary":
        return FilterSpec(has_salary=True), ("salary", "desc")
    if name == "saved":
        return FilterSpec(status="saved", hide_applied=False), None
    if name == "applied":
        return FilterSpec(status="applied", hide_applied=False), None
    raise KeyError(name)


def preset_page(name: str, df: DataFrame, now: dt.datetime, status: DataFrame | None = None, page_no: int = 1,
                per_page: int = 25, tie: str | None = "job_id", fresh_hours: float = 24) -> DataFrame:
    """A page of what a preset shows, in the preset's order (without one: as ``tie`` orders)."""
    spec, order = preset(name, df, fresh_hours=fresh_hours)
    hits = search(df, spec, now, status=status)
    if order:
        return page(hits, *order, page_no, per_page, tie)
    if page_no <= 1:
        return hits.orderBy(tie).limit(per_page)
    return hits.orderBy(tie).offset((clamp_page(hits.count(), page_no, per_page) - 1) * per_page).limit(per_page)


PRESET_NAMES = ["new-for-me", "my-roles", "remote", "entry", "has-salary", "saved", "applied"]
