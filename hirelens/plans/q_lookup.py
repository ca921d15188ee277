"""Registered queries: company lists, live/dead companies, fetch stats, run
metadata, shortlist, salary shards and lookup, coverage and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..operators import clean as C
from ..operators import quality as Q
from ..operators import salary as SA
from ..operators import shortlist as SL
from ..sources import companies as SC
from ..sources import raw as R
from ..sources import salary as SS
from ..session import materialize
from ..sources.trends import new_snapshot_dir
from . import fixtures as fx
from . import raw_fixture as rf
from . import sqlgen as g
from .q_search import W, jobs
from .q_sources import KEYS, SQL, WR
from .registry import register

DEAD_SQL = f"SELECT platform, slug FROM co WHERE c_acctbal < {rf.DEAD_BALANCE}"
NJ = "nj AS (" + "\nUNION ALL\n".join(SQL[p] for p in KEYS) + ")"
BASE = f"""{WR},
{NJ},
live AS (SELECT * FROM co WHERE NOT (c_acctbal < {rf.DEAD_BALANCE})),
est AS (SELECT platform, slug, CASE WHEN platform = 'BambooHR' AND status = 200
  AND content_type NOT LIKE '%application/json%' THEN 404 ELSE status END AS status FROM live),
per AS (SELECT ats AS platform, slug, count(*) AS jobs FROM nj GROUP BY 1, 2)"""


_run = rf.run_postings


@register("live_companies", f"{WR}\nSELECT platform, slug FROM co WHERE NOT (c_acctbal < {rf.DEAD_BALANCE})")
def q_live(spark, sf):
    comp = rf.companies(spark, sf)
    return Q.live_companies(comp, rf.known_dead(spark, sf)).select("platform", "slug")


@register("fetch_stats", f"""{BASE}
SELECT platform, count(*) AS checked, CAST(count_if(coalesce(jobs, 0) > 0) AS BIGINT) AS with_jobs,
 CAST(count_if(coalesce(jobs, 0) = 0) AS BIGINT) AS failed, CAST(count_if(coalesce(jobs, 0) = 0 AND status IN (404, 410)) AS BIGINT) AS newly_dead,
 CAST(coalesce(sum(jobs), 0) AS BIGINT) AS total_jobs
FROM est LEFT JOIN per USING (platform, slug) GROUP BY platform""")
def q_fetch_stats(spark, sf):
    _, live, raw, j = _run(spark, sf)
    return Q.fetch_stats(live, R.effective_status(raw), j)


@register("active_companies", f"{BASE}\nSELECT platform, slug, jobs FROM per")
def q_active(spark, sf):
    _, _, _, j = _run(spark, sf)
    return Q.active_companies(j)


@register("dead_slugs", f"""{BASE}
{DEAD_SQL}
UNION
SELECT e.platform, e.slug FROM est e LEFT JOIN per p USING (platform, slug)
WHERE coalesce(p.jobs, 0) = 0 AND e.status IN (404, 410)""")
def q_dead(spark, sf):
    _, live, raw, j = _run(spark, sf)
    return Q.update_dead(rf.known_dead(spark, sf), live, R.effective_status(raw), j)


_CLEAN = ("lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')) NOT IN ('not specified', 'n/a', 'unknown', '') "
          "AND coalesce(nullif(url, ''), nullif(absolute_url, '')) IS NOT NULL "
          "AND coalesce(nullif(company, ''), nullif(company_slug, '')) IS NOT NULL")


@register("run_metadata", f"""{BASE}
SELECT (SELECT count(DISTINCT slug) FROM co) AS total_companies, (SELECT count(*) FROM per) AS active_companies,
 count(*) AS total_jobs, CAST(count_if(coalesce(is_recruiter, false)) AS BIGINT) AS recruiter_jobs,
 'automated' AS source_type,
 'greenhouse_api, ashby_api, bamboohr_api, lever_api, workday_api, icims_sitemap, paylocity_scrape' AS platforms,
 '{fx.JOBS_NOW.strftime('%Y-%m-%dT%H:%M:%SZ')}' AS last_updated
FROM nj WHERE {_CLEAN}""")
def q_run_metadata(spark, sf):
    comp, _, _, j = _run(spark, sf)
    kept, _ = C.clean(j)
    return Q.run_metadata(comp, j, kept, fx.JOBS_NOW)


@register("all_companies", f"{WR}\nSELECT DISTINCT slug FROM co")
def q_all_companies(spark, sf):
    return Q.all_companies(rf.companies(spark, sf))


@register("clean_reasons_scrape", f"""{BASE}
SELECT CASE WHEN lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')) IN ('not specified', 'n/a', 'unknown', '')
 THEN 'no_title' WHEN coalesce(nullif(url, ''), nullif(absolute_url, '')) IS NULL THEN 'no_url' ELSE 'no_company' END AS reason,
 count(*) AS n FROM nj WHERE NOT ({_CLEAN}) GROUP BY 1""")
def q_clean_reasons_scrape(spark, sf):
    _, _, _, j = _run(spark, sf)
    return C.clean(j)[1]


@register("src_companies", f"""{WR}
SELECT platform, slug, CASE WHEN platform = 'Paylocity' THEN coalesce(name_plain, slug) END AS name FROM co""")
def q_src_companies(spark, sf):
    comp = rf.companies(spark, sf)
    base = new_snapshot_dir(spark, "companies")
    outs = []
    for p in presets.PLATFORMS:
        kind = "paylocity" if p == "Paylocity" else "flat"
        path = SC.write_companies(comp.filter(F.col("platform") == p), f"{base}/{p.lower()}", kind)
        outs.append(SC.read_companies(spark, path, kind).withColumn("platform", F.lit(p)))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res.select("platform", "slug", "name")


_SHORT = f"SELECT DISTINCT lower(ats) AS platform, company_slug AS slug FROM nj WHERE {g.role_match('title', 'skill_level')}"


@register("shortlist_build", f"{BASE}\n{_SHORT}")
def q_shortlist_build(spark, sf):
    _, _, _, j = _run(spark, sf)
    return SL.build_shortlist(j)[0]


@register("shortlist_stats", f"""{BASE}
SELECT lower(ats) AS platform, count(*) AS matched_jobs, CAST(0 AS BIGINT) AS unresolved FROM nj
WHERE {g.role_match('title', 'skill_level')} GROUP BY 1""")
def q_shortlist_stats(spark, sf):
    _, _, _, j = _run(spark, sf)
    return SL.build_shortlist(j)[1]


@register("slug_reverse", f"{BASE}\n{_SHORT}")
def q_slug_reverse(spark, sf):
    """Slim records (no company_slug): slugs recovered from company or the
    Workday / Paylocity reverse maps built from the company lists."""
    comp, _, _, j = _run(spark, sf)
    slim = j.drop("company_slug")
    return SL.build_shortlist(slim, reverse=SL.slug_reverse_maps(comp))[0]


@register("shortlist_apply", f"""{BASE},
sl AS ({_SHORT})
SELECT l.platform, l.slug FROM live l WHERE EXISTS (SELECT 1 FROM sl WHERE sl.platform = lower(l.platform) AND sl.slug = l.slug)""")
def q_shortlist_apply(spark, sf):
    comp, live, _, j = _run(spark, sf)
    short, _ = SL.build_shortlist(j)
    return SL.apply_shortlist(live.select("platform", "slug"), short)


# -- salary -----------------------------------------------------------------------
def salary_tables(spark, sf, postings=None):
    """Primary (company|title|level) and fallback (title|level) estimates from
    the postings' own salaries: min / floor(mean) / max / count."""
    j = (postings if postings is not None else jobs(spark, sf)).filter(F.col("salary_median").isNotNull())
    aggs = [F.min("salary_median").alias("p25"), F.floor(F.avg("salary_median")).cast("int").alias("median"),
            F.max("salary_median").alias("p75"), F.count("salary_median").cast("int").alias("n")]
    pk = F.concat_ws("|", SA.lookup_part("company"), SA.lookup_part("title"), F.col("skill_level"))
    fk = F.concat_ws("|", SA.lookup_part("title"), F.col("skill_level"))
    return j.groupBy(pk.alias("key")).agg(*aggs), j.groupBy(fk.alias("key")).agg(*aggs)


_SAL_AGG = ("min(salary_median) AS p25, CAST(floor(avg(salary_median)) AS INT) AS median, "
            "max(salary_median) AS p75, CAST(count(salary_median) AS INT) AS n")
_PK = "lower(trim(coalesce(company, ''))) || '|' || lower(trim(coalesce(title, ''))) || '|' || skill_level"
_FK = "lower(trim(coalesce(title, ''))) || '|' || skill_level"
_SAL_CTES = f"""{W},
prim AS (SELECT {_PK} AS key, {_SAL_AGG} FROM jobs_c WHERE salary_median IS NOT NULL GROUP BY 1),
fall AS (SELECT {_FK} AS key, {_SAL_AGG} FROM jobs_c WHERE salary_median IS NOT NULL GROUP BY 1)"""


def _salary_from_shards(spark, sf, postings=None):
    prim, fall = salary_tables(spark, sf, postings)
    path = SS.write_salary(prim, new_snapshot_dir(spark, "salary"))
    return SS.read_salary(spark, path), fall


@register("src_salary", f"""{_SAL_CTES}
SELECT key, split_part(key, '|', 1) AS company, split_part(key, '|', 2) AS title, split_part(key, '|', 3) AS level,
 p25, median, p75, n FROM prim""")
def q_src_salary(spark, sf):
    return _salary_from_shards(spark, sf)[0]


@register("salary_enrich", f"""{_SAL_CTES}
SELECT j.job_id, coalesce(p.p25, f.p25) AS p25, coalesce(p.median, f.median) AS median,
 coalesce(p.p75, f.p75) AS p75, coalesce(p.n, f.n) AS n,
 CASE WHEN p.key IS NOT NULL THEN 'primary' WHEN f.key IS NOT NULL THEN 'fallback' END AS salary_source
FROM jobs_c j LEFT JOIN prim p ON {_PK.replace('company', 'j.company').replace('title', 'j.title').replace('skill_level', 'j.skill_level')} = p.key
LEFT JOIN fall f ON {_FK.replace('title', 'j.title').replace('skill_level', 'j.skill_level')} = f.key""")
def q_salary_enrich(spark, sf):
    # the classified postings feed three steps: materialise them once, as the
    # pipeline's persisted job table would be
    postings = materialize(jobs(spark, sf), "jobs")
    prim, fall = _salary_from_shards(spark, sf, postings)
    e = SA.enrich_salary(postings, prim.select("key", "p25", "median", "p75", "n"), fall)
    return e.select("job_id", "salary.p25", "salary.median", "salary.p75", "salary.n", "salary_source")


# -- audits ---------------------------------------------------------------------------
@register("coverage_updated_at", f"""{BASE}
SELECT coalesce(ats, 'UNKNOWN') AS ats, nullif(updated_at, '') IS NOT NULL AS has_updated_at, count(*) AS n
FROM nj GROUP BY 1, 2""")
def q_coverage(spark, sf):
    _, _, _, j = _run(spark, sf)
    return Q.coverage(j)


AUDIT = {"Greenhouse": True, "Ashby": False, "iCIMS": False, "Workday": False}
_AUDIT_DOM = " UNION ALL ".join(f"SELECT {g.q(k)} AS platform, {str(v).upper()} AS must" for k, v in AUDIT.items())


@register("date_audit", f"""{BASE},
dom AS ({_AUDIT_DOM}),
a AS (SELECT ats AS platform, count(*) AS total, CAST(count_if(nullif(updated_at, '') IS NOT NULL) AS BIGINT) AS with_date,
  min(CASE WHEN nullif(updated_at, '') IS NOT NULL AND TRY_CAST(regexp_replace(updated_at, 'Z$', '+00:00') AS TIMESTAMPTZ) IS NULL
   THEN updated_at END) AS bad_example FROM nj GROUP BY 1)
SELECT d.platform, coalesce(a.with_date, 0) AS with_date, coalesce(a.total, 0) AS total,
 CASE WHEN coalesce(a.total, 0) = 0 THEN 'NO_JOBS' WHEN a.bad_example IS NOT NULL THEN 'BAD_FORMAT'
  WHEN a.with_date = 0 AND d.must THEN 'MISSING' WHEN a.with_date = 0 THEN 'NONE' ELSE 'OK' END AS verdict,
 a.bad_example FROM dom d LEFT JOIN a ON d.platform = a.platform""")
def q_date_audit(spark, sf):
    _, _, _, j = _run(spark, sf)
    return Q.date_audit(j, AUDIT)


def checked_urls(spark, sf):
    """Link checks over the postings: Lever links are all dead, Ashby links live
    only for finished orders, others live unless the order is pending."""
    o = fx.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus")
    j = fx.jobs_view(spark, sf).join(o, "job_id")
    alive = (F.when(F.col("ats") == "Lever", F.lit(False))
             .when(F.col("ats") == "Ashby", F.col("o_orderstatus") == "F")
             .otherwise(F.col("o_orderstatus") != "P"))
    return j.select(F.col("ats").alias("platform"), "url", alive.alias("alive"))


_PLAT_DOM = " UNION ALL ".join(f"SELECT {g.q(p)} AS platform" for p in presets.PLATFORMS)


@register("url_health", f"""{W},
ch AS (SELECT j.ats AS platform, j.url, CASE WHEN j.ats = 'Lever' THEN false WHEN j.ats = 'Ashby' THEN o.o_orderstatus = 'F'
  ELSE o.o_orderstatus <> 'P' END AS alive FROM jobs j JOIN orders o ON j.job_id = o.o_orderkey),
per AS (SELECT platform, count(*) AS total, CAST(count_if(coalesce(alive, false)) AS BIGINT) AS alive FROM ch GROUP BY 1),
dom AS ({_PLAT_DOM})
SELECT d.platform, coalesce(p.alive, 0) AS alive, coalesce(p.total, 0) AS total,
 CASE WHEN coalesce(p.total, 0) = 0 THEN 'NO_URLS' WHEN coalesce(p.alive, 0) = 0 THEN 'PATTERN_BROKEN'
  WHEN p.alive < p.total * 0.5 THEN 'DEGRADED' ELSE 'OK' END AS verdict
FROM dom d LEFT JOIN per p ON d.platform = p.platform""")
def q_url_health(spark, sf):
    return Q.url_health(checked_urls(spark, sf))
