"""Registered queries: classification, clean step, search controls, presets,
sorting and paging over the stand-in postings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..functions.classify import clean_reason, tier_score
from ..operators import clean as clean_op
from ..operators import search as S
from ..operators import word_index
from ..session import read_table
from . import fixtures as fx
from . import sqlgen as g
from .registry import register

NOW = fx.JOBS_NOW
OUT = ["job_id", "title", "company_slug"]
W = "WITH " + g.jobs_cte()
W_ST = W + ",\n" + g.status_cte()


def jobs(spark, sf):
    return S.classify_jobs(fx.jobs_view(spark, sf))


def _sql_filter(where: str, cols: str = "job_id, title, company_slug", with_=W, src="jobs_c") -> str:
    return f"{with_}\nSELECT {cols} FROM {src} WHERE {where}"


# -- flagship: role matches first seen in the window, newest first, top 60 -----
NEW_MATCHING_HOURS = 2160


@register("new_matching", f"""{W}
SELECT job_id, title, company, location, url, skill_level, first_seen,
 round({g.age_us('first_seen', NOW)} / 3600000000.0, 4) AS age_hours
FROM jobs_c
WHERE {g.role_match('title', 'skill_level')} AND first_seen IS NOT NULL
 AND {g.age_us('first_seen', NOW)} <= {NEW_MATCHING_HOURS * 3600000000.0}
ORDER BY first_seen DESC, job_id LIMIT 60""")
def q_new_matching(spark, sf):
    out = S.new_matching(jobs(spark, sf), NOW, hours=NEW_MATCHING_HOURS)
    return out.select("job_id", "title", "company", "location", "url", "skill_level", "first_seen", "age_hours")


@register("tier_score", f"""{W}
SELECT job_id, title, {g.tier_score('title')} AS tier_score, skill_level FROM jobs_c""")
def q_tier_score(spark, sf):
    j = jobs(spark, sf)
    return j.select("job_id", "title", tier_score("title").alias("tier_score"), "skill_level")


@register("is_recruiter", f"""{W}
SELECT job_id, company_slug, is_recruiter FROM jobs_c""")
def q_is_recruiter(spark, sf):
    return jobs(spark, sf).select("job_id", "company_slug", "is_recruiter")


@register("role_match", _sql_filter(g.role_match("title", "skill_level"), "job_id, title, skill_level"))
def q_role_match(spark, sf):
    from ..functions.classify import role_match
    return jobs(spark, sf).filter(role_match("title", "skill_level")).select("job_id", "title", "skill_level")


_CLEAN_SQL = r"""CASE WHEN lower(regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g')) IN ('not specified', 'n/a', 'unknown', '') THEN 'no_title'
 WHEN coalesce(nullif(url, ''), NULL) IS NULL THEN 'no_url'
 WHEN coalesce(nullif(company, ''), nullif(company_slug, '')) IS NULL THEN 'no_company' END"""


@register("clean_jobs", f"""{W}
SELECT job_id, title, url, company FROM jobs_c WHERE ({_CLEAN_SQL}) IS NULL""")
def q_clean_jobs(spark, sf):
    kept, _ = clean_op.clean(jobs(spark, sf))
    return kept.select("job_id", "title", "url", "company")


@register("clean_reasons", f"""{W},
torn AS (SELECT * REPLACE (CASE WHEN job_id % 17 = 0 THEN '' WHEN job_id % 17 <> 1 THEN url END AS url,
  CASE WHEN job_id % 19 <> 0 THEN company END AS company, CASE WHEN job_id % 19 <> 0 THEN company_slug ELSE '' END AS company_slug) FROM jobs_c)
SELECT reason, count(*) AS n FROM (SELECT {_CLEAN_SQL} AS reason FROM torn) t
WHERE reason IS NOT NULL GROUP BY reason""")
def q_clean_reasons(spark, sf):
    """Postings with URLs or companies torn off, so that each reason occurs."""
    k = F.col("job_id")
    torn = jobs(spark, sf).withColumns({
        "url": F.when(k % 17 == 0, "").when(k % 17 != 1, F.col("url")),
        "company": F.when(k % 19 != 0, F.col("company")),
        "company_slug": F.when(k % 19 != 0, F.col("company_slug")).otherwise("")})
    return clean_op.clean(torn)[1]


# -- single controls (recruiters shown unless the control is the recruiter one) --
def _search(spark, sf, spec, status=False):
    st = fx.status_table(spark, sf) if status else None
    return S.search(jobs(spark, sf), spec, NOW, status=st).select(*OUT)


NOT_RECR = "NOT coalesce(is_recruiter, false)"


@register("flt_recruiter", _sql_filter(NOT_RECR))
def q_flt_recruiter(spark, sf):
    return _search(spark, sf, S.FilterSpec())


@register("flt_title", _sql_filter(r"regexp_matches(lower(coalesce(title, '')), '\bengineer\b')"))
def q_flt_title(spark, sf):
    return _search(spark, sf, S.FilterSpec(hide_recruiters=False, title="Engineer"))


@register("flt_company", _sql_filter(
    r"regexp_matches(lower(coalesce(nullif(company, ''), company_slug, '')), '\bcustomer#000000042\b')"))
def q_flt_company(spark, sf):
    return _search(spark, sf, S.FilterSpec(hide_recruiters=False, company="Customer#000000042"))


_FUZZY = """(contains(lower(coalesce(location, '')), 'londn') OR len(list_filter(
   regexp_split_to_array(lower(coalesce(location, '')), '[^A-Za-z0-9_]+'),
   lambda w: length(w) > 0 AND 1.0 - levenshtein('londn', w) / greatest(length(w), 5) >= 0.75)) > 0)"""


@register("flt_location_fuzzy", _sql_filter(_FUZZY, "job_id, title, company_slug, location"))
def q_flt_location_fuzzy(spark, sf):
    j = jobs(spark, sf)
    return S.search(j, S.FilterSpec(hide_recruiters=False, location="Londn"), NOW).select(*OUT, "location")


@register("fuzzy_index_location", _sql_filter(_FUZZY, "job_id, title, company_slug, location"))
def q_fuzzy_index_location(spark, sf):
    """The same search through a stored index of the locations' words."""
    j = jobs(spark, sf)
    return word_index.fuzzy_filter(j, "location", word_index.build(j, "location"), "Londn", presets.FUZZY_THRESHOLD).select(*OUT, "location")


@register("fuzzy_index_words", """WITH words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^A-Za-z0-9_]+')) AS word FROM documents)
SELECT word, CAST(levenshtein('question', word) AS BIGINT) AS distance FROM words
WHERE word <> '' AND 1.0 - levenshtein('question', word) / greatest(length(word), 8) >= 0.6""")
def q_fuzzy_index_words(spark, sf):
    """Words of all documents that are close to a term, with their distances."""
    return word_index.close_words(word_index.build(read_table(spark, sf, "documents"), "text"), "question", 0.6)


@register("flt_include", _sql_filter(
    "(contains(lower(coalesce(title, '')), 'engineer') OR contains(lower(coalesce(title, '')), 'developer'))"))
def q_flt_include(spark, sf):
    return _search(spark, sf, S.FilterSpec(hide_recruiters=False, include="Engineer, developer ,"))


@register("flt_exclude", _sql_filter(
    "NOT (contains(lower(coalesce(title, '')), 'senior') OR contains(lower(coalesce(title, '')), 'staff'))"))
def q_flt_exclude(spark, sf):
    return _search(spark, sf, S.FilterSpec(hide_recruiters=False, exclude="senior,  Staff"))


@register("flt_ats_level", _sql_filter(
    "lower(coalesce(ats, '')) IN ('greenhouse', 'lever') AND lower(coalesce(skill_level, '')) IN ('entry', 'mid')",
    "job_id, title, company_slug, ats, skill_level"))
def q_flt_ats_level(spark, sf):
    j = jobs(spark, sf)
    spec = S.FilterSpec(hide_recruiters=False, ats="Greenhouse, lever", skill_level="entry,MID")
    return S.search(j, spec, NOW).select(*OUT, "ats", "skill_level")


@register("flt_salary", _sql_filter(
    "salary_median IS NOT NULL AND salary_median >= 100000 AND salary_median <= 300000",
    "job_id, title, company_slug, salary_median"))
def q_flt_salary(spark, sf):
    j = jobs(spark, sf)
    spec = S.FilterSpec(hide_recruiters=False, salary_min=100000, salary_max=300000)
    return S.search(j, spec, NOW).select(*OUT, "salary_median")


@register("flt_remote_text", _sql_filter("contains(lower(coalesce(location, '')), 'remote')"))
def q_flt_remote_text(spark, sf):
    return _search(spark, sf, S.FilterSpec(hide_recruiters=False, remote_only=True))


@register("flt_country", _sql_filter("(country = 'US' OR nullif(country, '') IS NULL)",
                                     "job_id, title, company_slug, country"))
def q_flt_country(spark, sf):
    j = jobs(spark, sf)
    spec = S.FilterSpec(hide_recruiters=False, country="US", include_unknown_country=True)
    return S.search(j, spec, NOW).select(*OUT, "country")


@register("flt_country_remote", _sql_filter("coalesce(remote, false)", "job_id, title, company_slug, remote"))
def q_flt_country_remote(spark, sf):
    j = jobs(spark, sf)
    return S.search(j, S.FilterSpec(hide_recruiters=False, country=S.REMOTE), NOW).select(*OUT, "remote")


@register("flt_fresh", _sql_filter(
    f"first_seen IS NOT NULL AND {g.age_us('first_seen', NOW)} <= {2160 * 3600000000.0}",
    "job_id, title, company_slug, first_seen"))
def q_flt_fresh(spark, sf):
    j = jobs(spark, sf)
    return S.search(j, S.FilterSpec(hide_recruiters=False, fresh_hours=2160), NOW).select(*OUT, "first_seen")


@register("flt_posted", _sql_filter(
    f"coalesce(updated_at, first_seen) IS NOT NULL AND "
    f"{g.age_us('coalesce(updated_at, first_seen)', NOW)} <= {60 * 86400000000.0}",
    "job_id, title, company_slug, updated_at, first_seen"))
def q_flt_posted(spark, sf):
    j = jobs(spark, sf)
    return (S.search(j, S.FilterSpec(hide_recruiters=False, posted_days=60), NOW)
            .select(*OUT, "updated_at", "first_seen"))


@register("flt_status", f"""{W_ST}
SELECT j.job_id, j.title, j.company_slug FROM jobs_c j LEFT JOIN status s ON j.url = s.url
WHERE coalesce(s.status, '') NOT IN ('applied', 'ignored')""")
def q_flt_status(spark, sf):
    return _search(spark, sf, S.FilterSpec(hide_recruiters=False, hide_applied=True), status=True)


SEARCH_SPEC = S.FilterSpec(role_preset=True, country="US", include_unknown_country=False, fresh_hours=2160,
                           hide_applied=True, salary_min=1000, exclude="intern", location="austin")


@register("search", f"""{W_ST}
SELECT j.job_id, j.title, j.company_slug FROM jobs_c j LEFT JOIN status s ON j.url = s.url
WHERE {NOT_RECR} AND coalesce(s.status, '') NOT IN ('applied', 'ignored')
 AND salary_median IS NOT NULL AND salary_median >= 1000 AND country = 'US'
 AND {g.role_match('title', 'skill_level')}
 AND first_seen IS NOT NULL AND {g.age_us('first_seen', NOW)} <= {2160 * 3600000000.0}
 AND NOT contains(lower(coalesce(title, '')), 'intern')
 AND contains(lower(coalesce(location, '')), 'austin')""")
def q_search(spark, sf):
    return _search(spark, sf, SEARCH_SPEC, status=True)


# -- presets ---------------------------------------------------------------------
def _preset(spark, sf, name):
    """All that a preset without an order shows."""
    j = jobs(spark, sf)
    spec, order = S.preset(name, j)
    assert order is None
    return S.search(j, spec, NOW, status=fx.status_table(spark, sf)).select(*OUT)


FRESH_HOURS = 120 * 24  # the stand-in postings arrive a few a day


def _preset_page(spark, sf, name, *extra):
    """The first page of a preset with an order."""
    page = S.preset_page(name, jobs(spark, sf), NOW, fx.status_table(spark, sf), per_page=50, fresh_hours=FRESH_HOURS)
    return page.select(*OUT, *extra)


_BASE_PRESET = f"{W_ST}\nSELECT j.job_id, j.title, j.company_slug FROM jobs_c j LEFT JOIN status s ON j.url = s.url\nWHERE {NOT_RECR}"

register("preset_new_for_me", f"""{_BASE_PRESET}
 AND coalesce(s.status, '') NOT IN ('applied', 'ignored') AND {g.role_match('title', 'skill_level')}
 AND first_seen IS NOT NULL AND {g.age_us('first_seen', NOW)} <= {FRESH_HOURS * 3600000000.0}
 AND (country = 'US' OR NOT EXISTS (SELECT 1 FROM jobs WHERE country = 'US'))
ORDER BY first_seen DESC NULLS LAST, j.job_id LIMIT 50""".replace("j.company_slug FROM", "j.company_slug, j.first_seen FROM"))(
    lambda spark, sf: _preset_page(spark, sf, "new-for-me", "first_seen"))
register("preset_my_roles", f"""{_BASE_PRESET} AND {g.role_match('title', 'skill_level')}
 AND (country = 'US' OR NOT EXISTS (SELECT 1 FROM jobs WHERE country = 'US'))""")(
    lambda spark, sf: _preset(spark, sf, "my-roles"))
register("preset_remote", f"{_BASE_PRESET} AND contains(lower(coalesce(location, '')), 'remote')")(
    lambda spark, sf: _preset(spark, sf, "remote"))
register("preset_entry", f"{_BASE_PRESET} AND lower(coalesce(skill_level, '')) = 'entry'")(
    lambda spark, sf: _preset(spark, sf, "entry"))
register("preset_has_salary", f"""{_BASE_PRESET} AND salary_median IS NOT NULL
ORDER BY salary_median DESC NULLS LAST, j.job_id LIMIT 50""".replace("j.company_slug FROM", "j.company_slug, j.salary_median FROM"))(
    lambda spark, sf: _preset_page(spark, sf, "has-salary", "salary_median"))
register("preset_saved", f"{_BASE_PRESET} AND coalesce(s.status, '') = 'saved'")(
    lambda spark, sf: _preset(spark, sf, "saved"))
register("preset_applied", f"{_BASE_PRESET} AND coalesce(s.status, '') = 'applied'")(
    lambda spark, sf: _preset(spark, sf, "applied"))


# -- sorting and paging: a page of the order is what makes the order observable ----
def _sql_page(order: str, limit: int, offset: int = 0, cols: str = "job_id, title, company_slug") -> str:
    off = f" OFFSET {offset}" if offset else ""
    return f"{W}\nSELECT {cols} FROM jobs_c ORDER BY {order}, job_id LIMIT {limit}{off}"


@register("sort_salary", _sql_page("salary_median DESC NULLS LAST", 100, cols="job_id, title, company_slug, salary_median"))
def q_sort_salary(spark, sf):
    return S.page(jobs(spark, sf), "salary", "desc", 1, 100).select(*OUT, "salary_median")


@register("sort_salary_asc_nulls", f"""{W}
SELECT job_id, title, company_slug, salary_median FROM jobs_c ORDER BY salary_median ASC NULLS LAST, job_id
LIMIT 100 OFFSET (SELECT greatest(0, count(salary_median) - 50) FROM jobs_c)""")
def q_sort_salary_asc(spark, sf):
    """Around the end of the priced rows in ascending order: the last of them, then the first NULLs."""
    j = jobs(spark, sf)
    n = j.agg(F.count("salary_median").alias("priced"), F.count(F.lit(1)).alias("rows")).first()
    return S.sorted_rows(j, "salary", "asc", max(0, n.priced - 50), 100, n["rows"]).select(*OUT, "salary_median")


@register("sort_first_seen", _sql_page("first_seen DESC NULLS LAST", 50, cols="job_id, title, company_slug, first_seen"))
def q_sort_first_seen(spark, sf):
    return S.page(jobs(spark, sf), "first_seen", "desc", 1, 50).select(*OUT, "first_seen")


@register("sort_text", _sql_page("nullif(lower(trim(coalesce(title, ''))), '') DESC NULLS LAST", 100,
                                 cols="job_id, title, company_slug"))
def q_sort_text(spark, sf):
    return S.page(jobs(spark, sf), "title", "desc", 1, 100).select(*OUT)


@register("page", _sql_page("coalesce(updated_at, first_seen) DESC NULLS LAST", 50, offset=100,
                            cols="job_id, title, company_slug, updated_at"))
def q_page(spark, sf):
    return S.page(jobs(spark, sf), "posted", "desc", 3, 50).select(*OUT, "updated_at")


@register("page_past_end", f"""{W}
SELECT job_id, title, company_slug FROM jobs_c
ORDER BY nullif(lower(trim(coalesce(company, company_slug, ''))), '') ASC NULLS LAST, job_id
LIMIT 25 OFFSET (SELECT (greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) - 1) * 25 FROM jobs_c)""")
def q_page_past_end(spark, sf):
    return S.page(jobs(spark, sf), "company", "asc", 10**9, 25).select(*OUT)
