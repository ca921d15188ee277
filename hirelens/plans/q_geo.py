"""Registered queries: location normalise / parse / fallbacks, gazetteer maps,
resolution cascade and country backfill over per-order location strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as FG
from ..operators import geo as G
from ..sources.gazetteer import read_gazetteer, write_gazetteer
from ..sources.trends import new_snapshot_dir
from . import fixtures as fx
from . import raw_fixture as rf
from . import sqlgen_geo as sg
from .registry import register

WG = "WITH " + sg.geo_postings_cte()


def _maps(spark, sf):
    return rf.gazetteer(spark, sf)


@register("loc_normalize", f"{WG}\nSELECT job_id, location, {sg.norm('location')} AS normalized FROM gp")
def q_loc_normalize(spark, sf):
    p = G.per_distinct(fx.geo_postings(spark, sf), "location", normalized=FG.loc_normalize("location"))
    return p.select("job_id", "location", "normalized")


@register("is_remote", f"""{WG}
SELECT job_id, CASE WHEN {sg.norm('location')} IN ({', '.join(sg.q(g) for g in FG.P.GARBAGE_LOCATIONS)}) THEN false
 ELSE {sg.any_contains(sg.norm('location'), FG.P.REMOTE_KEYWORDS)} END AS is_remote FROM gp""")
def q_is_remote(spark, sf):
    p = G.per_distinct(fx.geo_postings(spark, sf), "location", is_remote=FG.is_remote("location"))
    return p.select("job_id", "is_remote")


@register("loc_parse", f"""{WG},
{sg.parse_ctes('gp')}
SELECT location, remote, city, admin, country FROM parsed""")
def q_loc_parse(spark, sf):
    d = fx.geo_postings(spark, sf).select("location").distinct()
    d = d.withColumn("_n", FG.loc_normalize("location"))
    p = FG.parse_locations(d, "_n", "p")
    return p.select("location", F.col("p_remote").alias("remote"), F.col("p_city").alias("city"),
                    F.col("p_admin").alias("admin"), F.col("p_country").alias("country"))


@register("country_fallback", f"""{WG}
SELECT DISTINCT location, {sg.country_from_freetext('location')} AS freetext,
 {sg.country_from_address('location')} AS address,
 {sg.country_from_remote(sg.norm('location'))} AS remote_country FROM gp""")
def q_country_fallback(spark, sf):
    d = fx.geo_postings(spark, sf).select("location").distinct()
    return d.select("location", FG.country_from_freetext("location").alias("freetext"),
                    FG.country_from_address("location").alias("address"),
                    FG.country_from_remote(FG.loc_normalize("location")).alias("remote_country"))


@register("gazetteer_maps", f"""WITH {sg.gazetteer_ctes()}
SELECT 'city_admin_country' AS map, city_n, admin_n, country, lat, lng FROM m_cac
UNION ALL SELECT 'city_country', city_n, NULL, country, lat, lng FROM m_cc
UNION ALL SELECT 'city_admin', city_n, admin_n, NULL, lat, lng FROM m_ca
UNION ALL SELECT 'city', city_n, NULL, NULL, lat, lng FROM m_c
UNION ALL SELECT 'city_to_country', city_n, NULL, country, NULL, NULL FROM m_c2c""")
def q_gazetteer_maps(spark, sf):
    """The lookup maps themselves (first row wins per key), from gazetteer files."""
    path = write_gazetteer(fx.gazetteer(spark, sf), new_snapshot_dir(spark, "gazetteer-files"), rows_per_file=40)
    m = G.gazetteer_maps(read_gazetteer(spark, path))
    null = F.lit(None)
    out = [m["city_admin_country"].select(F.lit("city_admin_country").alias("map"), "city_n", "admin_n", "country", "xy.lat", "xy.lng"),
           m["city_country"].select(F.lit("city_country").alias("map"), "city_n", null.cast("string").alias("admin_n"), "country", "xy.lat", "xy.lng"),
           m["city_admin"].select(F.lit("city_admin").alias("map"), "city_n", "admin_n", null.cast("string").alias("country"), "xy.lat", "xy.lng"),
           m["city"].select(F.lit("city").alias("map"), "city_n", null.cast("string").alias("admin_n"), null.cast("string").alias("country"), "xy.lat", "xy.lng"),
           m["city_to_country"].select(F.lit("city_to_country").alias("map"), "city_n", null.cast("string").alias("admin_n"), "country",
                                       null.cast("double").alias("lat"), null.cast("double").alias("lng"))]
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


@register("geo_resolve", f"""{WG},
{sg.resolve_ctes('gp')}
SELECT g.job_id, g.location, coalesce(r.remote, false) AS geo_remote, r.lat AS geo_lat, r.lng AS geo_lng, r.country AS geo_country
FROM gp g LEFT JOIN resolved r ON g.location IS NOT DISTINCT FROM r.location""")
def q_geo_resolve(spark, sf):
    r = G.resolve_locations(fx.geo_postings(spark, sf), _maps(spark, sf))
    return r.select("job_id", "location", "geo_remote", "geo_lat", "geo_lng", "geo_country")


_BF = f"""{WG},
{sg.resolve_ctes("(SELECT coalesce(location, '') AS location FROM gp WHERE nullif(country, '') IS NULL)")},
bf AS (SELECT g.job_id, nullif(g.country, '') IS NOT NULL AS skip, r.country AS new_c, g.country AS old_c,
  coalesce(g.location, '') AS loc FROM gp g LEFT JOIN resolved r ON coalesce(g.location, '') = r.location)"""


@register("country_backfill", f"""{_BF}
SELECT job_id, CASE WHEN skip THEN old_c ELSE new_c END AS country FROM bf""")
def q_country_backfill(spark, sf):
    out, _, _ = G.backfill_country(fx.geo_postings(spark, sf), _maps(spark, sf))
    return out.select("job_id", "country")


@register("country_backfill_report", f"""{_BF}
SELECT count(*) AS total, CAST(count_if(NOT skip AND new_c IS NOT NULL) AS BIGINT) AS resolved,
 CAST(count_if(skip) AS BIGINT) AS already_set, CAST(count_if(NOT skip AND new_c IS NULL) AS BIGINT) AS unresolved,
 count(DISTINCT CASE WHEN NOT skip THEN loc END) AS distinct_locations,
 round(count_if(NOT skip AND new_c IS NULL) / greatest(count(*), 1) * 100, 1) AS unresolved_pct FROM bf""")
def q_country_backfill_report(spark, sf):
    return G.backfill_country(fx.geo_postings(spark, sf), _maps(spark, sf))[1]


@register("country_backfill_top", f"""{_BF}
SELECT country, count(*) AS n FROM (SELECT CASE WHEN skip THEN old_c ELSE new_c END AS country FROM bf
 WHERE skip OR new_c IS NOT NULL) t GROUP BY country ORDER BY n DESC, country LIMIT 5""")
def q_country_backfill_top(spark, sf):
    return G.backfill_country(fx.geo_postings(spark, sf), _maps(spark, sf), top=5)[2]
