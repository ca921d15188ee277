"""Registered queries: platform normalisers over derived raw responses, union,
fetch statistics, dead/live companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.geo import enrich_postings
from ..sources import raw as R
from . import fixtures as fx
from . import raw_fixture as rf
from . import sqlgen as g
from . import sqlgen_geo as sg
from .registry import register

WR = "WITH " + g.jobs_cte() + ",\n" + g.raw_ctes()
OUT = ["slug", "company", "company_slug", "title", "location", "url", "absolute_url", "departments", "id",
       "updated_at", "remote_flag", "is_recruiter", "ats", "skill_level", "location_full", "remote", "lat", "lng", "country"]


def _out(df):
    return df.select(*[F.array_join("departments", "|").alias("departments") if c == "departments" else c for c in OUT])


def _raw(spark, sf):
    return rf.all_responses(spark, sf)


def _maps(spark, sf):
    return rf.gazetteer(spark, sf)


def _names(spark, sf):
    return rf.companies(spark, sf).select("slug", "name")


NULL_S = "CAST(NULL AS VARCHAR)"


def _sel(platform: str, company: str, title: str, location: str, url: str, absolute_url: str = NULL_S,
         departments: str = NULL_S, id_: str = NULL_S, updated_at: str = NULL_S, remote_flag: str = "NULL",
         recruiter_of: str = "slug", where: str = "", cut: bool = True,
         lookup: str | None = "location") -> str:
    cond = f"platform = {g.q(platform)}" + (f" AND {where}" if where else "")
    shown = f"substr({location}, 1, 50)" if cut else location
    asked = {"location": shown, "full": location, None: NULL_S}[lookup]
    return f"""SELECT slug, {company} AS company, slug AS company_slug, {title} AS title, {shown} AS location,
 {location} AS location_full, {asked} AS lookup,
 {url} AS url, {absolute_url} AS absolute_url, {departments} AS departments, {id_} AS id,
 {updated_at} AS updated_at, CAST({remote_flag} AS BOOLEAN) AS remote_flag,
 {g.is_recruiter(recruiter_of)} AS is_recruiter, {g.q(platform)} AS ats, {g.tier(title)} AS skill_level
FROM cj WHERE {cond}"""


ISO = "strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ')"
TITLE_SLUG = "replace(replace(replace(lower(title), '/', '%2F'), '&', '%26'), ' ', '-')"
CITY = "split_part(location, ', ', 1)"
STATE = "CASE WHEN len(string_split(location, ', ')) > 1 THEN split_part(location, ', ', 2) END"

SQL = {
    "Greenhouse": _sel("Greenhouse", "slug", "title", "coalesce(location, 'Not specified')", "url", "url",
                       "CASE WHEN job_id % 3 = 0 THEN 'Engineering' ELSE 'Operations' END",
                       "CAST(job_id AS VARCHAR)", ISO, cut=False),
    "Ashby": _sel("Ashby", "slug", "coalesce(title, '')",
                  "coalesce(CASE WHEN job_id % 7 = 0 THEN location || ' / Hybrid office, second floor, building C' "
                  "ELSE location END, 'Not specified')",
                  "'https://jobs.ashbyhq.com/' || slug || '/' || CAST(job_id AS VARCHAR)"),
    "BambooHR": _sel("BambooHR", "slug", "title",
                     "coalesce(CASE WHEN job_id % 4 = 1 THEN location || ' (main campus, north entrance, third floor)' "
                     f"ELSE nullif(concat_ws(', ', nullif({CITY}, ''), nullif({STATE}, '')), '') END, 'Not specified')",
                     "'https://' || slug || '.bamboohr.com/careers/' || CAST(job_id AS VARCHAR)",
                     where="content_type LIKE '%application/json%'", lookup="full"),
    "Lever": _sel("Lever", "slug", "title", "coalesce(location, 'Not specified')",
                  "'https://jobs.lever.example/' || CAST(job_id AS VARCHAR)"),
    "Workday": _sel("Workday", "split_part(slug, '|', 1)", "title",
                    "coalesce(nullif(location, ''), 'Not specified')",
                    "'https://' || split_part(slug, '|', 1) || '.wd' || replace(split_part(slug, '|', 2), 'wd', '') "
                    f"|| '.myworkdayjobs.com/' || split_part(slug, '|', 3) || '/jobs/' || CAST(job_id AS VARCHAR) || '/' || {TITLE_SLUG}",
                    updated_at="strftime(scraped_at, '%Y-%m-%d')", recruiter_of="split_part(slug, '|', 1)",
                    where="(c_custkey % 11 <> 0 OR page = 0)"),
    "iCIMS": _sel("iCIMS", "slug", g.pytitle("trim(replace(lower(title), '-', ' '))"), "'Not specified'",
                  f"'https://careers-' || slug || '.icims.com/jobs/' || CAST(job_id AS VARCHAR) || '/' || {TITLE_SLUG} || '/job'",
                  updated_at="strftime(updated_at, '%Y-%m-%d')", remote_flag="false",
                  lookup=None),
    "Paylocity": _sel("Paylocity", "coalesce(name_plain, slug)",
                      "CASE WHEN job_id % 13 = 0 THEN title || ' & Ops' ELSE title END",
                      f"CASE WHEN nullif({CITY}, '') IS NOT NULL AND nullif({STATE}, '') IS NOT NULL THEN {CITY} || ', ' || {STATE} "
                      f"WHEN nullif({CITY}, '') IS NOT NULL THEN {CITY} ELSE 'Main' END",
                      "CASE WHEN job_id % 6 <> 0 THEN 'https://recruiting.paylocity.com/recruiting/Jobs/Details/' || CAST(job_id AS VARCHAR) "
                      "ELSE 'https://recruiting.paylocity.com/recruiting/jobs/All/' || slug || '/' END",
                      "CASE WHEN job_id % 6 <> 0 THEN 'https://recruiting.paylocity.com/recruiting/Jobs/Details/' || CAST(job_id AS VARCHAR) "
                      "ELSE 'https://recruiting.paylocity.com/recruiting/jobs/All/' || slug || '/' END",
                      "CASE WHEN job_id % 5 = 0 THEN 'R&D' ELSE '' END",
                      "CASE WHEN job_id % 6 <> 0 THEN CAST(job_id AS VARCHAR) END", ISO, "job_id % 10 = 3",
                      recruiter_of="coalesce(name_plain, slug)", where="c_custkey % 13 NOT IN (5, 7)", cut=False),
}
KEYS = {"Greenhouse": "norm_greenhouse", "Ashby": "norm_ashby", "BambooHR": "norm_bamboohr", "Lever": "norm_lever",
        "Workday": "norm_workday", "iCIMS": "norm_icims", "Paylocity": "norm_paylocity"}


def enriched(rows: str) -> str:
    """``rows`` with remote, lat, lng, country from the gazetteer."""
    return f"""{WR},
u AS ({rows}),
{sg.resolve_ctes("(SELECT lookup AS location FROM u WHERE lookup IS NOT NULL)")},
e AS (SELECT u.*, coalesce(remote_flag, false) OR coalesce(r.remote, false) AS remote, r.lat, r.lng, r.country
 FROM u LEFT JOIN resolved r ON r.location = u.lookup)"""


def _make(platform):
    def q(spark, sf):
        raw = _raw(spark, sf)
        fn = R.NORMALIZERS[platform]
        out = fn(raw, _names(spark, sf)) if platform == "Paylocity" else fn(raw)
        return _out(enrich_postings(out, _maps(spark, sf)))
    return q


for _p, _k in KEYS.items():
    register(_k, f"{enriched(SQL[_p])}\nSELECT * EXCLUDE (lookup) FROM e")(_make(_p))


@register("union_platforms", enriched("\nUNION ALL\n".join(SQL[p] for p in KEYS)) + f"""
SELECT ats, slug, url, title, location_full, remote, lat, lng, country, {g.ts(fx.JOBS_NOW)} AS scraped_at, 'automated' AS source FROM e""")
def q_union_platforms(spark, sf):
    raw, names = _raw(spark, sf), _names(spark, sf)
    u = R.union_platforms(*[R.NORMALIZERS[p](raw, names) if p == "Paylocity" else R.NORMALIZERS[p](raw) for p in KEYS],
                          scraped_at=fx.ts_lit(fx.JOBS_NOW))
    return enrich_postings(u, _maps(spark, sf)).select(
        "ats", "slug", "url", "title", "location_full", "remote", "lat", "lng", "country", "scraped_at", "source")
