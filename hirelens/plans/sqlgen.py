"""DuckDB SQL fragments for the independent oracle.

Built from the same fixed values as the Spark expressions but written as plain
ANSI/DuckDB SQL (RE2 regexes), so the oracle does not share code paths with
the Spark plans it checks.
"""

from __future__ import annotations

import datetime as dt

from .. import presets
from . import fixtures as fx

# RE2 has no look-ahead. ``\b(?:i|1)\b(?!\s*-|\d)`` is rewritten to the
# equivalent consuming form (a digit can never follow the boundary anyway).
_RE2_REWRITES = {r"\b(?:i|1)\b(?!\s*-|\d)": r"\b(?:i|1)\b\s*(?:$|[^\s\-])"}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ts(value: dt.datetime) -> str:
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


def tier_score(col: str) -> str:
    parts = []
    for pattern, weight in presets.TIER_RULES:
        p = _RE2_REWRITES.get(pattern, pattern)
        parts.append(f"CASE WHEN regexp_matches(lower(coalesce({col}, '')), {q(p)}) THEN {weight} ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def tier(col: str) -> str:
    s = tier_score(col)
    return (f"(CASE WHEN {s} <= {presets.TIER_INTERN_MAX} THEN 'intern' "
            f"WHEN {s} <= {presets.TIER_ENTRY_MAX} THEN 'entry' "
            f"WHEN {s} >= {presets.TIER_SENIOR_MIN} THEN 'senior' ELSE 'mid' END)")


def is_recruiter(col: str) -> str:
    terms = " OR ".join(f"contains(lower(coalesce({col}, '')), {q(t)})" for t in presets.RECRUITER_TERMS)
    return f"({terms})"


def role_match(title: str, level: str, preset=None) -> str:
    preset = preset or presets.ROLE_PRESET
    t = f"coalesce({title}, '')"
    conds = [f"{t} <> ''"]
    if preset.get("levels"):
        conds.append(f"coalesce({level}, '') IN ({', '.join(q(x) for x in preset['levels'])})")
    conds.append(f"regexp_matches({t}, {q('|'.join(preset['include']))}, 'i')")
    if preset.get("exclude"):
        conds.append(f"NOT regexp_matches({t}, {q('|'.join(preset['exclude']))}, 'i')")
    return "(" + " AND ".join(conds) + ")"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return str(v) if isinstance(v, (int, float)) else q(v)


def _case(expr: str, pairs, default=None) -> str:
    body = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs)
    tail = f" ELSE {lit(default)}" if default is not None else ""
    return f"CASE {expr} {body}{tail} END"


def jobs_cte() -> str:
    """The stand-in postings view (identical rows to ``fixtures.jobs_view``)."""
    title = _case("o.o_orderkey % 12", list(enumerate(fx.TITLES)))
    ats = _case("o.o_orderpriority", fx.PRIORITY_ATS, fx.DEFAULT_ATS)
    places = list(enumerate(fx.NATION_PLACES))
    loc = _case("c.c_nationkey % 6", [(i, p[0]) for i, p in places if p[0] is not None])
    ctry = _case("c.c_nationkey % 6", [(i, p[1]) for i, p in places if p[1] is not None])
    lat = _case("c.c_nationkey % 6", [(i, p[2]) for i, p in places if p[2] is not None])
    lng = _case("c.c_nationkey % 6", [(i, p[3]) for i, p in places if p[3] is not None])
    return f"""jobs AS (
 SELECT o.o_orderkey AS job_id, c.c_name AS company,
  CASE WHEN c.c_custkey % 9 = 0 THEN 'acme staffing' ELSE c.c_name END AS company_slug,
  {title} AS title,
  {ats} AS ats,
  {loc} AS location,
  {ctry} AS country,
  c.c_nationkey % 6 = 1 AS remote,
  CAST({lat} AS DOUBLE) AS lat,
  CAST({lng} AS DOUBLE) AS lng,
  concat('https://example.com/jobs/', o.o_orderkey) AS url,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(o.o_totalprice) AS INT) END AS salary_median,
  CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o.o_orderdate - INTERVAL '3' DAY END AS updated_at,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_orderdate END AS first_seen,
  o.o_orderdate AS scraped_at
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
jobs_c AS (
 SELECT *, {tier('title')} AS skill_level,
  {is_recruiter("coalesce(nullif(company_slug, ''), company)")} AS is_recruiter
 FROM jobs)"""


def status_cte() -> str:
    return """status AS (
 SELECT concat('https://example.com/jobs/', o_orderkey) AS url,
  CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'P' THEN 'ignored' ELSE 'saved' END AS status,
  CAST(o_orderdate AS DATE) AS date
 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"""


def age_us(col: str, now: dt.datetime) -> str:
    return f"(epoch_us({ts(now)}) - epoch_us({col}))"


def event_postings_cte() -> str:
    ats = _case("event_type", fx.EVENT_ATS, fx.EVENT_DEFAULT_ATS)
    return f"""ep0 AS (
 SELECT event_id AS seq, {ats} AS ats,
  concat('company-', CAST(user_id % 17 AS VARCHAR)) AS company,
  concat('https://jobs.example.com/', event_type, '/jobs/', CAST(user_id AS VARCHAR)) AS url,
  CASE WHEN event_type = 'purchase' AND value >= 10 THEN CAST(user_id AS VARCHAR) END AS id,
  concat(event_type, ' role ', CAST(user_id AS VARCHAR)) AS title,
  ts AS scraped_at,
  CASE WHEN value < 5 THEN NULL ELSE ts - INTERVAL 1 DAY END AS first_seen
 FROM events),
ep AS (
 SELECT *, CASE
   WHEN ats = 'Workday' AND regexp_extract(coalesce(url, ''), '/jobs/(\\d+)', 1) <> ''
     THEN concat('workday:', coalesce(company, ''), ':', regexp_extract(coalesce(url, ''), '/jobs/(\\d+)', 1))
   WHEN ats = 'Paylocity' AND nullif(id, '') IS NOT NULL THEN concat('paylocity:', id)
   WHEN ats = 'Paylocity' THEN concat('paylocity:', coalesce(company, ''), ':', coalesce(title, ''))
   ELSE coalesce(url, '') END AS key
 FROM ep0),
ex AS (SELECT * FROM ep WHERE scraped_at < {ts(fx.EVENTS_SPLIT)}),
nw AS (SELECT * EXCLUDE (first_seen) FROM ep WHERE scraped_at >= {ts(fx.EVENTS_SPLIT)})"""


def _platform_case(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % 7 = {i} THEN {q(p)}" for i, p in enumerate(presets.PLATFORMS)) + " END"


def pytitle(expr: str) -> str:
    """Python str.title(): capitalise each letter run, lower the rest."""
    return (f"array_to_string(list_transform(regexp_extract_all({expr}, '(\\p{{L}}+|\\P{{L}}+)', 1), "
            "lambda t: CASE WHEN regexp_matches(t, '^\\p{L}') THEN (CASE WHEN t[1] = 'ß' THEN 'Ss' ELSE upper(t[1]) END) "
            "|| lower(t[2:]) ELSE t END), '')")


def raw_ctes() -> str:
    """Companies (one per customer) and their postings with page numbers."""
    plat = _platform_case("c_custkey")
    return f"""co0 AS (SELECT c_custkey, c_nationkey, c_name, c_acctbal, {plat} AS platform FROM customer),
co AS (
 SELECT c_custkey, c_acctbal, platform,
  CASE platform WHEN 'Workday' THEN concat(lower(replace(c_name, '#', '-')), '|wd', CAST(c_nationkey % 5 + 1 AS VARCHAR), '|careers')
   WHEN 'Paylocity' THEN lower(concat(lpad(hex(c_custkey), 8, '0'), '-0000-4000-8000-', lpad(hex(c_custkey * 7919), 12, '0')))
   ELSE lower(replace(c_name, '#', '-')) END AS slug,
  CASE WHEN platform <> 'Paylocity' THEN NULL WHEN c_nationkey % 4 = 0 THEN c_name || ' & Sons'
   WHEN c_nationkey % 4 = 1 THEN NULL ELSE c_name END AS name_plain,
  CASE WHEN c_acctbal < -800 THEN 404 WHEN c_acctbal < -600 THEN 410 WHEN c_acctbal < -400 THEN 429 ELSE 200 END AS status,
  CASE WHEN platform = 'BambooHR' AND c_acctbal >= 0 AND c_acctbal < 300 THEN 'text/html' ELSE 'application/json' END AS content_type
 FROM co0),
jp AS (
 SELECT j.*, o.o_custkey AS c_custkey,
  CAST((row_number() OVER (PARTITION BY o.o_custkey ORDER BY j.job_id) - 1) // 20 AS INT) AS page
 FROM jobs j JOIN orders o ON j.job_id = o.o_orderkey),
cj AS (SELECT co.*, jp.* EXCLUDE (c_custkey) FROM co JOIN jp ON co.c_custkey = jp.c_custkey WHERE co.status = 200)"""
