"""Registered queries: facets, stats, heat buckets, markers and label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..functions import labels as L
from ..operators import facets as FA
from ..operators import map_index
from ..operators import partials as PA
from ..operators import search as S
from ..sources.trends import new_snapshot_dir
from . import fixtures as fx
from . import sqlgen as g
from .q_search import NOT_RECR, NOW, W, jobs
from .registry import register


@register("facet_country", f"""{W},
pc AS (SELECT coalesce(nullif(country, ''), '__unknown__') AS value, count(*) AS n,
  CAST(count_if(coalesce(remote, false)) AS BIGINT) AS r FROM jobs_c GROUP BY 1)
SELECT value, n FROM pc UNION ALL SELECT '__remote__' AS value, CAST(sum(r) AS BIGINT) AS n FROM pc""")
def q_facet_country(spark, sf):
    return FA.facet_country(jobs(spark, sf))


@register("facet_ats_level", f"""{W}
SELECT 'ats' AS facet, lower(ats) AS value, count(*) AS n FROM jobs_c WHERE nullif(lower(ats), '') IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'skill_level' AS facet, lower(skill_level) AS value, count(*) AS n FROM jobs_c
WHERE nullif(lower(skill_level), '') IS NOT NULL GROUP BY 2""")
def q_facet_ats_level(spark, sf):
    return FA.facet_counts(jobs(spark, sf), ("ats", "skill_level"))


@register("stat_companies", f"""{W}
SELECT count(*) AS total_jobs, count(DISTINCT coalesce(nullif(company_slug, ''), company)) AS companies FROM jobs_c""")
def q_stat_companies(spark, sf):
    return FA.stats(jobs(spark, sf), NOW).select("total_jobs", "companies")


@register("stat_fresh", f"""{W}
SELECT CAST(count_if(epoch_us(first_seen) >= epoch_us({g.ts(NOW)}) - 86400000000) AS BIGINT) AS fresh_24h,
 CAST(count_if({NOT_RECR}) AS BIGINT) AS matching FROM jobs_c""")
def q_stat_fresh(spark, sf):
    j = jobs(spark, sf)
    return FA.stats(j, NOW, matching=S.predicate(j, S.FilterSpec(), NOW)).select("fresh_24h", "matching")


PART_ROWS = 5000


def _partials(spark, sf):
    """The postings' partial aggregates by parts of job ids. The last part arrives later, and the first one comes again."""
    j = jobs(spark, sf)
    root = new_snapshot_dir(spark, "partials")
    part, last = F.floor(F.col("job_id") / PART_ROWS), j.agg(F.max("job_id")).first()[0] // PART_ROWS
    matching = S.predicate(j, S.FilterSpec(), NOW)
    for some in (part < last, part == last, part == 0):
        PA.put(spark, root, PA.partial(j.filter(some), part, matching=matching))
    return j, PA.read(spark, root)


@register("partial_facets", f"""{W}
SELECT 'ats' AS facet, lower(ats) AS value, count(*) AS n FROM jobs_c WHERE nullif(lower(ats), '') IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'skill_level' AS facet, lower(skill_level) AS value, count(*) AS n FROM jobs_c
WHERE nullif(lower(skill_level), '') IS NOT NULL GROUP BY 2
UNION ALL SELECT 'country' AS facet, coalesce(nullif(country, ''), '__unknown__') AS value, count(*) AS n FROM jobs_c GROUP BY 2
UNION ALL SELECT 'country' AS facet, '__remote__' AS value, count(*) AS n FROM jobs_c WHERE remote""")
def q_partial_facets(spark, sf):
    return PA.counts(_partials(spark, sf)[1], ("ats", "skill_level", "country"))


@register("partial_totals", f"""{W}
SELECT count(*) AS total_jobs, CAST(count_if({NOT_RECR}) AS BIGINT) AS matching,
 CAST(count_if(epoch_us(first_seen) >= epoch_us({g.ts(NOW)}) - 86400000000 * 90) AS BIGINT) AS fresh FROM jobs_c""")
def q_partial_totals(spark, sf):
    return PA.totals(_partials(spark, sf)[1], NOW, hours=90 * 24)


@register("partial_companies", f"""{W}
SELECT lower(ats) AS value, count(*) AS n, true AS close FROM jobs_c WHERE nullif(lower(ats), '') IS NOT NULL GROUP BY 1""")
def q_partial_companies(spark, sf):
    """Distinct companies a platform, from sketches: within 6 % (some four standard errors) of the exact number."""
    j, parts = _partials(spark, sf)
    company = F.coalesce(F.nullif(F.col("company_slug"), F.lit("")), F.col("company"))
    exact = j.groupBy(F.lower("ats").alias("value")).agg(F.count_distinct(company).alias("exact"))
    both = PA.companies(parts, "ats").join(exact, "value")
    return both.select("value", "n", (F.abs(F.col("companies") - F.col("exact")) <= 0.06 * F.col("exact")).alias("close"))


@register("heatmap", f"""{W}
SELECT lat, lng, count(*) AS n FROM jobs_c WHERE lat IS NOT NULL AND lng IS NOT NULL
GROUP BY lat, lng HAVING count(*) >= {presets.HEAT_MIN_COUNT}""")
def q_heatmap(spark, sf):
    return FA.heat_buckets(jobs(spark, sf))


def _sql_num_text(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


_HASH = ("list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(k, ''), "
         "lambda ch: CAST(unicode(ch) AS BIGINT))), lambda acc, x: (acc * 31 + x) % 4294967296)")


@register("heatmap_jitter", f"""{W},
b AS (SELECT lat, lng, count(*) AS n FROM jobs_c WHERE lat IS NOT NULL AND lng IS NOT NULL
  GROUP BY lat, lng HAVING count(*) >= {presets.HEAT_MIN_COUNT}),
h AS (SELECT *, {_HASH} AS hv FROM (SELECT *, concat({_sql_num_text('lat')}, ',', {_sql_num_text('lng')}) AS k FROM b))
SELECT lat, lng, n, lat + ((hv & 65535) / 65535.0 - 0.5) * 0.02 AS heat_lat,
 lng + (((hv >> 16) & 65535) / 65535.0 - 0.5) * 0.02 AS heat_lng FROM h""")
def q_heatmap_jitter(spark, sf):
    return FA.heat_buckets(jobs(spark, sf), jitter=True)


# companies of many initials, hexadecimal and all-digit names among them
_INITIALS = "abcdefghijklmnopqrstuvwxyz0123456789éÅ"
_NAMED = f"""named AS (SELECT * REPLACE (CASE WHEN job_id % 41 = 0 THEN CAST(job_id + 10000000 AS VARCHAR)
  WHEN job_id % 43 = 0 THEN 'deadbeef' || (job_id % 10) ELSE '{_INITIALS}'[job_id % {len(_INITIALS)} + 1] || company END AS company) FROM jobs_c)"""


def _named(spark, sf):
    k = F.col("job_id")
    initial = F.substring(F.lit(_INITIALS), (k % len(_INITIALS) + 1).cast("int"), F.lit(1))
    return jobs(spark, sf).withColumn("company", F.when(k % 41 == 0, (k + 10_000_000).cast("string"))
                                      .when(k % 43 == 0, F.concat(F.lit("deadbeef"), (k % 10).cast("string")))
                                      .otherwise(F.concat(initial, "company")))


def _markers_sql(south, west, north, east) -> str:
    return f"""{W},
{_NAMED},
c AS (SELECT lower(substr(company, 1, 1)) AS initial, job_id, company, title, lat, lng, salary_median,
  row_number() OVER (PARTITION BY lower(substr(company, 1, 1)) ORDER BY job_id) AS rn
  FROM named WHERE lat IS NOT NULL AND lng IS NOT NULL AND company IS NOT NULL AND company <> ''
  AND NOT regexp_matches(company, '^\\d+$') AND NOT regexp_matches(company, '^[a-f0-9]{{8,}}$', 'i')
  AND lat BETWEEN {south} AND {north} AND lng BETWEEN {west} AND {east})
SELECT initial, job_id, company, title, lat, lng, salary_median, coalesce(salary_median <> 0, false) AS salaried
FROM c WHERE rn = 1 ORDER BY job_id LIMIT {presets.MARKER_LIMIT}"""


@register("marker_sample", _markers_sql(-90, -180, 90, 180))
def q_marker_sample(spark, sf):
    return FA.marker_sample(_named(spark, sf), box=(-90, -180, 90, 180))


#: A viewport: the middle of Europe.
VIEWPORT = (40, -10, 56, 30)


def _map(spark, sf):
    return map_index.build(_named(spark, sf), F.col("job_id"), 64)


@register("marker_viewport", _markers_sql(*VIEWPORT))
def q_marker_viewport(spark, sf):
    """The markers of a viewport, from the folders of the map index that it meets."""
    return FA.marker_sample(_map(spark, sf).inside(VIEWPORT))


@register("heat_viewport", f"""{W}
SELECT lat, lng, count(*) AS n FROM jobs_c WHERE lat BETWEEN {VIEWPORT[0]} AND {VIEWPORT[2]} AND lng BETWEEN {VIEWPORT[1]} AND {VIEWPORT[3]}
GROUP BY lat, lng HAVING count(*) >= {presets.HEAT_MIN_COUNT}""")
def q_heat_viewport(spark, sf):
    """The heat buckets of a viewport, from the same folders."""
    return FA.heat_buckets(_map(spark, sf).inside(VIEWPORT))


# -- label functions --------------------------------------------------------------
def _sql_hours(c: str) -> str:
    return f"({g.age_us(c, NOW)} / 3600000000.0)"


_H = _sql_hours("first_seen")
_D = f"floor({_sql_hours('coalesce(updated_at, first_seen)')} / 24)"


@register("age_label", f"""{W}
SELECT job_id,
 CASE WHEN {_H} IS NULL THEN NULL WHEN {_H} < 1 THEN 'just now'
  WHEN {_H} < 24 THEN concat(CAST(floor({_H}) AS BIGINT), 'h ago')
  WHEN floor({_H} / 24) = 1 THEN 'yesterday' ELSE concat(CAST(floor({_H} / 24) AS BIGINT), 'd ago') END AS first_seen_label,
 CASE WHEN {_D} IS NULL THEN NULL WHEN {_D} = 0 THEN 'Today' WHEN {_D} = 1 THEN 'Yesterday'
  WHEN {_D} < 30 THEN concat(CAST({_D} AS BIGINT), 'd ago')
  ELSE strftime(coalesce(updated_at, first_seen), '%b %-d') END AS posted_label
FROM jobs_c""")
def q_age_label(spark, sf):
    j = jobs(spark, sf)
    return j.select("job_id", L.age_label("first_seen", NOW).alias("first_seen_label"),
                    L.posted_label(F.coalesce("updated_at", "first_seen"), NOW).alias("posted_label"))


_FH = _sql_hours("last_scraped")


@register("freshness_level", f"""{W}
SELECT company, last_scraped, CASE WHEN {_FH} IS NULL THEN NULL WHEN {_FH} > {presets.FRESH_DANGER_HOURS} THEN 'danger'
 WHEN {_FH} > {presets.FRESH_WARNING_HOURS} THEN 'warning' ELSE 'ok' END AS level
FROM (SELECT company, max(scraped_at) AS last_scraped FROM jobs_c GROUP BY company) t""")
def q_freshness_level(spark, sf):
    per = jobs(spark, sf).groupBy("company").agg(F.max("scraped_at").alias("last_scraped"))
    return per.withColumn("level", L.freshness_level("last_scraped", NOW))


_NAMES = " ".join(f"WHEN {g.q(k)} THEN {g.q(v)}" for k, v in presets.COUNTRY_NAMES.items())
_CAP = ("array_to_string(list_transform(regexp_extract_all(replace(company_slug, '-', ' '), "
        "'([A-Za-z0-9_]+|[^A-Za-z0-9_]+)', 1), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9_]') "
        "THEN upper(t[1]) || t[2:] ELSE t END), '')")


@register("display_labels", f"""{W}
SELECT job_id, {_CAP} AS company_label, CASE country {_NAMES} ELSE country END AS country_label,
 CASE WHEN salary_median IS NULL THEN NULL ELSE concat('$', CAST(round(salary_median / 1000.0) AS BIGINT), 'k') END AS salary_label
FROM jobs_c""")
def q_display_labels(spark, sf):
    j = jobs(spark, sf)
    return j.select("job_id", L.company_display("company_slug").alias("company_label"),
                    L.country_name("country").alias("country_label"), L.money_k("salary_median").alias("salary_label"))


def salary_text(spark, sf):
    """A free-text salary per order: 'k' ranges, hourly, plain and unparseable."""
    o = fx.read_table(spark, sf, "orders")
    k = F.floor(F.col("o_totalprice") / 1000).cast("bigint")
    txt = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("$"), k.cast("string"), F.lit("k - $"),
                                                          (k + 20).cast("string"), F.lit("K")))
           .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("$"), F.floor(F.col("o_totalprice") / 2080)
                                                        .cast("bigint").cast("string"), F.lit("/hr")))
           .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("$"), F.floor("o_totalprice").cast("bigint").cast("string")))
           .otherwise(F.col("o_orderstatus")))
    return o.select(F.col("o_orderkey").alias("job_id"), txt.alias("salary_text"))


_K = "CAST(floor(o_totalprice / 1000) AS BIGINT)"
_ST = f"""CASE WHEN o_orderkey % 4 = 0 THEN concat('$', {_K}, 'k - $', {_K} + 20, 'K')
 WHEN o_orderkey % 4 = 1 THEN concat('$', CAST(floor(o_totalprice / 2080) AS BIGINT), '/hr')
 WHEN o_orderkey % 4 = 2 THEN concat('$', CAST(floor(o_totalprice) AS BIGINT)) ELSE o_orderstatus END"""


def _sql_num(v: str) -> str:
    return (f"CAST(nullif(regexp_extract({v}, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE)")


def _sql_conv(v: str) -> str:
    return f"(CASE WHEN {v} IS NULL OR {v} = '' THEN NULL WHEN contains({v}, 'k') THEN {_sql_num(v)} * 1000 ELSE {_sql_num(v)} END)"


@register("parse_salary", f"""WITH t AS (SELECT o_orderkey AS job_id, {_ST} AS salary_text FROM orders),
s AS (SELECT job_id, salary_text, lower(trim(regexp_replace(salary_text, '[$,]', '', 'g'))) AS s FROM t),
p AS (SELECT *, contains(s, '/hr') AS hourly, split_part(s, '/', 1) AS head FROM s),
r AS (SELECT *, trim(split_part(head, '-', 1)) AS lo_raw,
  CASE WHEN len(string_split(head, '-')) > 1 THEN trim(split_part(head, '-', 2)) ELSE trim(split_part(head, '-', 1)) END AS hi_raw FROM p),
c AS (SELECT *, {_sql_conv('lo_raw')} AS lo, {_sql_conv('hi_raw')} AS hi, CASE WHEN hourly THEN 2080.0 ELSE 1.0 END AS mult FROM r)
SELECT job_id, salary_text,
 CASE WHEN salary_text IS NOT NULL AND salary_text <> '' AND lo IS NOT NULL THEN lo * mult END AS salary_min,
 CASE WHEN salary_text IS NOT NULL AND salary_text <> '' AND lo IS NOT NULL THEN
   CASE WHEN hourly AND hi IS NULL THEN 0.0 ELSE hi * mult END END AS salary_max
FROM c""")
def q_parse_salary(spark, sf):
    t = salary_text(spark, sf)
    p = L.parse_salary("salary_text")
    return t.select("job_id", "salary_text", p["min"].alias("salary_min"), p["max"].alias("salary_max"))
