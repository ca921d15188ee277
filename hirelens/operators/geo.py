"""Gazetteer lookups: location strings -> remote flag, coordinates, country.

Plan: DISTINCT location strings -> normalise (one Arrow UDF for NFD) and
parse (native expressions) -> a cascade of equi left joins against the
gazetteer maps -> join back to the postings. The distinct step bounds the
expensive work by the number of distinct strings, not rows; the join back is
an equi join on the string with one row per key on the small side, so Spark's
size check broadcasts it when small and AQE splits a hot location otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from ..functions.geo import country_from_address, country_from_freetext, lit_map, loc_normalize, parse_locations
from ..functions.text import strip_accents
from ..session import materialize


def gazetteer_maps(gaz: DataFrame, pos: str = "pos") -> dict[str, DataFrame]:
    """Five lookup tables from gazetteer rows (city, admin, country, lat, lng,
    pos). City/admin are normalised like queries; rows with an empty city are
    skipped; the FIRST row (smallest ``pos``) wins per key (min_by aggregate)."""
    g = gaz.select(loc_normalize("city").alias("city_n"), loc_normalize("admin").alias("admin_n"),
                   F.nullif(F.col("country"), F.lit("")).alias("country"),
                   F.struct(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).alias("xy"),
                   F.col(pos).alias("pos")).filter(F.col("city_n") != "")
    g = materialize(g, "gazetteer")  # normalised once, whatever the number of lookups

    def first(df: DataFrame, keys: list[str], val: str = "xy") -> DataFrame:
        return df.groupBy(*keys).agg(F.min_by(F.col(val), F.col("pos")).alias(val))

    has_admin, has_country = F.col("admin_n") != "", F.col("country").isNotNull()
    maps = {
        "city_admin_country": first(g.filter(has_admin & has_country), ["city_n", "admin_n", "country"]),
        "city_country": first(g.filter(has_country), ["city_n", "country"]),
        "city_admin": first(g.filter(has_admin), ["city_n", "admin_n"]),
        "city": first(g, ["city_n"]),
        "city_to_country": first(g.filter(has_country), ["city_n"], "country"),
    }
    return {name: materialize(m, name) for name, m in maps.items()}


def per_distinct(df: DataFrame, col: str, **exprs: Column) -> DataFrame:
    """Add expressions of one column, computed once for each distinct value of it."""
    own = df.select(col).distinct().select(F.col(col).alias("_v"), *[e.alias(n) for n, e in exprs.items()])
    return df.join(own, df[col].eqNullSafe(own["_v"]), "left").drop("_v")


def _lk(df: DataFrame, m: DataFrame, on: dict, out: str, val: str = "xy") -> DataFrame:
    """Left-join one map: ``on`` maps the map's key columns to expressions."""
    keys = [f"_k{i}" for i in range(len(on))]
    left = df
    for k, expr in zip(keys, on.values()):
        left = left.withColumn(k, expr)
    right = m.select(*[F.col(c).alias(k) for c, k in zip(on.keys(), keys)], F.col(val).alias(out))
    return left.join(right, keys, "left").drop(*keys)


def resolve_distinct(locs: DataFrame, maps: dict[str, DataFrame], col: str = "location") -> DataFrame:
    """(location, remote, lat, lng, country) for DISTINCT location strings,
    keeping the reference branch order: remote; no city -> free-text country;
    NYC boroughs; a US state abbreviation that the gazetteer contradicts; then
    city+admin+country, city+country, city+admin, famous-city default, city."""
    d = (locs.select(F.col(col).alias("location")).distinct()
         .withColumn("_acc", strip_accents(F.col("location")))
         .withColumn("_n", loc_normalize(F.col("_acc"), accents_stripped=True)))
    d = parse_locations(d, "_n", "_p").drop("_acc", "_n")
    city0 = F.col("_p_city")
    admin = F.lower(F.col("_p_admin"))
    city = F.when(city0.isin(P.NYC_BOROUGHS) & (admin == "ny"), F.lit("new york city")).otherwise(city0)
    d = d.select("location", F.col("_p_remote").alias("remote"), city.alias("city"), admin.alias("admin"),
                 F.col("_p_country").alias("country0"))
    # Materialise the parsed DISTINCT strings in the shared folder: bounded by distinct locations, it stops the optimizer from
    # pushing the join cascade back into the staged parse expressions, and gives
    # the joins below real size statistics.
    d = materialize(d, "locations")

    d = _lk(d, maps["city_admin_country"], {"city_n": F.col("city"), "admin_n": F.col("admin"), "country": F.lit("US")}, "_us")
    d = _lk(d, maps["city_to_country"], {"city_n": F.col("city")}, "_known", "country")
    override = ((F.col("country0") == "US") & F.col("admin").isNotNull() & (F.length("admin") == 2) & F.col("_us").isNull()
                & F.col("_known").isNotNull() & (F.col("_known") != "US"))
    d = d.withColumn("country", F.when(override, F.col("_known")).otherwise(F.col("country0")))

    fam_c = F.try_element_at(lit_map(P.FAMOUS_CITY_DEFAULTS), F.col("city"))
    fam_a = F.try_element_at(lit_map(P.FAMOUS_CITY_ADMIN), F.col("city"))
    d = d.withColumn("_fc", F.when(F.col("country").isNull(), fam_c)).withColumn("_fa", fam_a)
    d = _lk(d, maps["city_admin_country"], {"city_n": F.col("city"), "admin_n": F.col("admin"), "country": F.col("country")}, "_c1")
    d = _lk(d, maps["city_country"], {"city_n": F.col("city"), "country": F.col("country")}, "_c2")
    d = _lk(d, maps["city_admin"], {"city_n": F.col("city"), "admin_n": F.col("admin")}, "_c3")
    d = _lk(d, maps["city_admin_country"], {"city_n": F.col("city"), "admin_n": F.col("_fa"), "country": F.col("_fc")}, "_c4")
    d = _lk(d, maps["city_country"], {"city_n": F.col("city"), "country": F.col("_fc")}, "_c5")
    d = _lk(d, maps["city"], {"city_n": F.col("city")}, "_c6")

    has_city = F.col("city").isNotNull() & (F.col("city") != "")
    famous = F.col("_fc").isNotNull()
    xy = (F.when(F.col("remote") | ~has_city, F.lit(None))
          .when(F.col("admin").isNotNull() & F.col("country").isNotNull() & F.col("_c1").isNotNull(), F.col("_c1"))
          .when(F.col("country").isNotNull() & F.col("_c2").isNotNull(), F.col("_c2"))
          .when(F.col("admin").isNotNull() & F.col("_c3").isNotNull(), F.col("_c3"))
          .when(famous & F.col("_fa").isNotNull() & F.col("_c4").isNotNull(), F.col("_c4"))
          .when(famous & F.col("_c5").isNotNull(), F.col("_c5"))
          .otherwise(F.col("_c6")))
    country_or_known = F.coalesce(F.col("country"), F.col("_known"))
    country = (F.when(F.col("remote"), F.col("country0"))
               .when(~has_city, F.coalesce(F.col("country0"), country_from_freetext(F.col("location"))))
               .when(F.col("admin").isNotNull() & F.col("country").isNotNull() & F.col("_c1").isNotNull(), F.col("country"))
               .when(F.col("country").isNotNull() & F.col("_c2").isNotNull(), F.col("country"))
               .when(F.col("admin").isNotNull() & F.col("_c3").isNotNull(), country_or_known)
               .when(famous & F.col("_fa").isNotNull() & F.col("_c4").isNotNull(), F.col("_fc"))
               .when(famous & F.col("_c5").isNotNull(), F.col("_fc"))
               .when(F.col("_c6").isNotNull(), country_or_known)
               .otherwise(F.coalesce(country_or_known, country_from_address(F.col("location")),
                                     country_from_freetext(F.col("location")))))
    return d.select("location", F.col("remote"), xy["lat"].alias("lat"), xy["lng"].alias("lng"),
                    country.alias("country"))


def resolve_locations(df: DataFrame, maps: dict[str, DataFrame], col: str = "location") -> DataFrame:
    """Add ``geo_remote``, ``geo_lat``, ``geo_lng``, ``geo_country`` to every row."""
    res = resolve_distinct(df, maps, col).select(
        F.col("location").alias("_loc"), F.col("remote").alias("geo_remote"), F.col("lat").alias("geo_lat"),
        F.col("lng").alias("geo_lng"), F.col("country").alias("geo_country"))
    out = df.join(res, df[col].eqNullSafe(res["_loc"]), "left").drop("_loc")
    return out.withColumn("geo_remote", F.coalesce("geo_remote", F.lit(False)))


def enrich_postings(postings: DataFrame, maps: dict[str, DataFrame], lookup: str = "lookup") -> DataFrame:
    """Add ``remote``, ``lat``, ``lng``, ``country`` to normalised postings from their
    ``lookup`` text (NULL: nothing to look up). A posting is remote if its platform
    says so or its text does."""
    res = resolve_distinct(postings.filter(F.col(lookup).isNotNull()), maps, lookup)
    res = res.select(F.col("location").alias("_loc"), F.col("remote").alias("_remote"), "lat", "lng", "country")
    out = postings.join(res, F.col(lookup) == F.col("_loc"), "left")
    remote = F.coalesce("remote_flag", F.lit(False)) | F.coalesce("_remote", F.lit(False))
    return out.withColumn("remote", remote).drop("_loc", "_remote")


def backfill_country(df: DataFrame, maps: dict[str, DataFrame], force: bool = False, col: str = "location",
                     top: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fill ``country`` where missing (all rows when ``force``) from one lookup
    per DISTINCT location. Returns (rows, summary(total, resolved,
    already_set, unresolved, unresolved_pct, distinct_locations), top countries)."""
    base = df.withColumn("_loc", F.coalesce(F.col(col), F.lit("")))
    todo = base if force else base.filter(F.nullif(F.col("country"), F.lit("")).isNull())
    res = resolve_distinct(todo.select(F.col("_loc").alias("location")), maps).select(
        F.col("location").alias("_loc"), F.col("country").alias("_new"))
    j = base.join(res, "_loc", "left")
    had = F.nullif(F.col("country"), F.lit("")).isNotNull()
    skip = had & F.lit(not force)
    final = F.when(skip, F.col("country")).otherwise(F.coalesce(F.col("_new"), F.when(F.lit(force), F.col("country"))))
    out = j.withColumn("_skip", skip).withColumn("_resolved", ~skip & F.col("_new").isNotNull()) \
        .withColumn("country", final)
    summary = out.agg(F.count(F.lit(1)).alias("total"), F.count_if("_resolved").alias("resolved"),
                      F.count_if("_skip").alias("already_set"),
                      F.count_if(~F.col("_skip") & ~F.col("_resolved")).alias("unresolved"),
                      F.count_distinct(F.when(~F.col("_skip"), F.col("_loc"))).alias("distinct_locations"))
    summary = summary.withColumn("unresolved_pct", F.round(F.col("unresolved") / F.greatest(F.col("total"), F.lit(1)) * 100, 1))
    counted = out.filter(F.col("_skip") | F.col("_resolved"))
    tops = (counted.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("country")).limit(top))
    return out.drop("_loc", "_new", "_skip", "_resolved"), summary, tops
