"""Stand-in inputs derived by Spark from the driver tables.

The driver tables hold no postings, so postings, scrape logs and status tables
are *derived* from them (orders ⋈ customer, events, lineitem, pages). Every
derivation scales with its source tables; nothing here is a fixed small input.
The same derivations are written as SQL in ``plans.oracle`` for DuckDB.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# FIXED VALUES: the stand-in view's clock and its title / platform / location domains.
JOBS_NOW = dt.datetime(2001, 8, 2, 0, 0, 0)
TITLES = [
    "Senior Software Engineer", "Junior DevOps Engineer", "Software Engineer II",
    "Sales Director", "Backend Developer Intern", "Cloud Engineer", "Nurse Assistant",
    "Staff Site Reliability Engineer", "Web Developer I", "N/A", "Clerk 1 - Nights",
    "Platform Engineer",
]
PRIORITY_ATS = [("1-URGENT", "Workday"), ("2-HIGH", "Greenhouse"), ("3-MEDIUM", "Lever"),
                ("4-NOT SPECIFIED", "Ashby")]
DEFAULT_ATS = "iCIMS"
# nation % 6 -> (location, country, lat, lng)
NATION_PLACES = [
    ("Austin, TX", "US", 30.2672, -97.7431),
    ("Remote - US", "US", None, None),
    ("London", "GB", 51.5074, -0.1278),
    ("Not specified", None, None, None),
    ("Toronto, Canada", "CA", 43.6532, -79.3832),
    (None, None, None, None),
]
# Events stand in for scrape runs; split day between "existing" and "new" loads.
EVENTS_SPLIT = dt.datetime(2024, 1, 21)
EVENTS_NOW = dt.datetime(2024, 2, 15)


def ts_lit(value: dt.datetime) -> Column:
    """TIMESTAMP_NTZ literal (driver timestamps are NTZ)."""
    return F.to_timestamp_ntz(F.lit(value.isoformat(sep=" ")))


def _case(key: Column, pairs, default=None) -> Column:
    out = None
    for k, v in pairs:
        out = (F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v)))
    return out.otherwise(F.lit(default)) if default is not None else out


def jobs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per order: company = customer, title/platform/place chosen by
    rules over the order and customer keys."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    nk = F.col("c_nationkey") % 6
    okey = F.col("o_orderkey")
    title = _case(okey % 12, list(enumerate(TITLES)))
    return j.select(
        okey.alias("job_id"),
        F.col("c_name").alias("company"),
        F.when(F.col("c_custkey") % 9 == 0, F.lit("acme staffing")).otherwise(F.col("c_name")).alias("company_slug"),
        title.alias("title"),
        _case(F.col("o_orderpriority"), PRIORITY_ATS, DEFAULT_ATS).alias("ats"),
        _case(nk, [(i, p[0]) for i, p in enumerate(NATION_PLACES) if p[0] is not None]).alias("location"),
        _case(nk, [(i, p[1]) for i, p in enumerate(NATION_PLACES) if p[1] is not None]).alias("country"),
        (nk == 1).alias("remote"),
        _case(nk, [(i, p[2]) for i, p in enumerate(NATION_PLACES) if p[2] is not None]).cast("double").alias("lat"),
        _case(nk, [(i, p[3]) for i, p in enumerate(NATION_PLACES) if p[3] is not None]).cast("double").alias("lng"),
        F.concat(F.lit("https://example.com/jobs/"), okey.cast("string")).alias("url"),
        F.when(okey % 4 == 0, F.lit(None)).otherwise(F.floor("o_totalprice").cast("int")).alias("salary_median"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None))
         .otherwise(F.col("o_orderdate") - F.expr("INTERVAL 3 DAYS")).alias("updated_at"),
        F.when(okey % 5 == 0, F.lit(None)).otherwise(F.col("o_orderdate")).alias("first_seen"),
        F.col("o_orderdate").alias("scraped_at"),
    )


def status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application status per URL: the user acted on urgent/high orders;
    F = applied, P = ignored, otherwise saved."""
    o = read_table(spark, sf_dir, "orders")
    return (o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .select(F.concat(F.lit("https://example.com/jobs/"), F.col("o_orderkey").cast("string")).alias("url"),
                    F.when(F.col("o_orderstatus") == "F", "applied")
                     .when(F.col("o_orderstatus") == "P", "ignored")
                     .otherwise("saved").alias("status"),
                    F.to_date("o_orderdate").alias("date")))


# events -> postings: platform by event type, one posting per (user, type).
EVENT_ATS = [("click", "Workday"), ("purchase", "Paylocity")]
EVENT_DEFAULT_ATS = "Greenhouse"


def event_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape log rows: each event is one sighting of a posting. ``seq`` =
    event_id is the arrival order used by last-wins."""
    from ..functions.classify import dedup_key

    e = read_table(spark, sf_dir, "events")
    uid = F.col("user_id").cast("string")
    rows = e.select(
        F.col("event_id").alias("seq"),
        _case(F.col("event_type"), EVENT_ATS, EVENT_DEFAULT_ATS).alias("ats"),
        F.concat(F.lit("company-"), (F.col("user_id") % 17).cast("string")).alias("company"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("event_type"), F.lit("/jobs/"), uid).alias("url"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") >= 10), uid).alias("id"),
        F.concat(F.col("event_type"), F.lit(" role "), uid).alias("title"),
        F.col("ts").alias("scraped_at"),
        F.when(F.col("value") < 5, F.lit(None)).otherwise(F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("first_seen"),
    )
    return rows.withColumn("key", dedup_key("url", "ats", "company", "id", "title"))


def existing_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_postings(spark, sf_dir).filter(F.col("scraped_at") < ts_lit(EVENTS_SPLIT))


def new_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new scrape carries no first_seen of its own (the merge sets it)."""
    return (event_postings(spark, sf_dir).filter(F.col("scraped_at") >= ts_lit(EVENTS_SPLIT))
            .drop("first_seen"))


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status clicks per URL from lineitem: R = applied, A = ignored, N = saved;
    ``seq`` orders them (ship date, then line attributes)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("https://example.com/jobs/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.when(F.col("l_returnflag") == "R", "applied").when(F.col("l_returnflag") == "A", "ignored")
         .otherwise("saved").alias("status"),
        F.to_date("l_shipdate").alias("date"),
        ((F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000) * 8 + F.col("l_linenumber"))
         * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).cast("bigint").alias("seq"),
        "l_partkey", "l_suppkey")


EVENTS_LAST_DAY = dt.date(2024, 1, 30)


# FIXED VALUES: a small gazetteer (city, admin, country, lat, lng) in file
# order — duplicates exercise first-row-wins, famous-city pins and overrides.
GAZETTEER = [
    ("Houston", "MO", "US", 37.3265, -91.9557),
    ("Houston", "TX", "US", 29.7633, -95.3633),
    ("Houston", "BC", "CA", 54.3996, -126.6702),
    ("Austin", "TX", "US", 30.2672, -97.7431),
    ("London", "ENG", "GB", 51.5074, -0.1278),
    ("London", "ON", "CA", 42.9834, -81.233),
    ("Berlin", "BE", "DE", 52.52, 13.405),
    ("Berlin", "NH", "US", 44.4687, -71.1851),
    ("Omaha", "NE", "US", 41.2586, -95.9378),
    ("Brooklyn", "NY", "US", 40.6782, -73.9442),
    ("New York City", "NY", "US", 40.7128, -74.006),
    ("Chicago", "IL", "US", 41.8781, -87.6298),
    ("Wilmington", "DE", "US", 39.7391, -75.5398),
    ("Toronto", "ON", "CA", 43.6532, -79.3832),
    ("Paris", "TX", "US", 33.6609, -95.5555),
    ("Paris", "IDF", "FR", 48.8566, 2.3522),
    ("Springfield", "MO", "US", 37.2153, -93.2982),
    ("Springfield", "IL", "US", 39.7817, -89.6501),
    ("San Jose", "", "CR", 9.9281, -84.0907),
    ("San Jose", "CA", "US", 37.3382, -121.8863),
    ("Cork", "", "IE", 51.8985, -8.4756),
    ("Bengaluru", "KA", "IN", 12.9716, 77.5946),
    ("Montréal", "QC", "CA", 45.5017, -73.5673),
    ("Saint Paul", "MN", "US", 44.9537, -93.09),
    ("Fort Worth", "TX", "US", 32.7555, -97.3308),
    ("Seattle", "WA", "US", 47.6062, -122.3321),
    ("Dublin", "", "IE", 53.3498, -6.2603),
    ("Dublin", "OH", "US", 40.0992, -83.1141),
    ("Lagos", "LA", "NG", 6.5244, 3.3792),
    ("", "XX", "US", 0.0, 0.0),
]

# FIXED VALUES: posting location strings covering each parse branch.
LOCATION_STRINGS = [
    "Remote - US", "Austin, TX", "London", "Berlin, DE", "Houston", "Omaha, NE", "Brooklyn, NY",
    "USA-Illinois-Chicago", "Polaris, OH 43210", "Wilmington NC USA", "3 locations", None,
    "Remote, Canada", "Remote (US time zones)", "Hybrid in Toronto, Canada", "Paris", "Springfield",
    "San Jose", "Bangalore", "Montréal, QC", "St. Paul, MN", "Ft. Worth, TX", "NYC", "Chicago HQ, IL",
    "Austin TX", "Cork, IN", "France", "Seattle, WA, USA", "London, UK", "Toronto (Main Office), ON",
    "Dublin", "Lagos, Nigeria", "anywhere", "Work from Home - Arkansas", "Not Specified", "",
]


# FIXED VALUES: second words of the towns that suppliers stand for.
TOWN_WORDS = ["Harbour", "Saint Cross", "Mt. Ridge", "Nörd"]


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The special rows above, then a town for each supplier in its nation. Towns
    repeat, so that the first row of a key has to win."""
    rows = [(c, a, k, la, ln, i) for i, (c, a, k, la, ln) in enumerate(GAZETTEER)]
    special = spark.createDataFrame(rows, "city string, admin string, country string, lat double, lng double, pos long")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("s_suppkey").cast("long")
    word = _case(key % 4, list(enumerate(TOWN_WORDS)))
    towns = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.initcap(F.lower("n_name")), F.lit(" "), word).alias("city"),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("R"), (key % 3).cast("string"))).alias("admin"),
        F.substring("n_name", 1, 2).alias("country"), ((key * 37 % 180) - 90).cast("double").alias("lat"),
        ((key * 91 % 360) - 180).cast("double").alias("lng"), (key + len(GAZETTEER)).alias("pos"))
    return special.unionByName(towns)


def geo_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One location string per order: a branch-covering string picked by the
    order and nation keys, or the customer's nation name (alone or remote)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = (F.col("o_orderkey") + F.col("c_nationkey")) % (len(LOCATION_STRINGS) + 2)
    nation = F.initcap(F.lower("n_name"))
    loc = _case(k, [(i, s) for i, s in enumerate(LOCATION_STRINGS) if s is not None])
    loc = (F.when(k == len(LOCATION_STRINGS), nation)
           .when(k == len(LOCATION_STRINGS) + 1, F.concat(F.lit("Remote, "), nation))
           .otherwise(loc))
    return j.select(F.col("o_orderkey").alias("job_id"), loc.alias("location"),
                    F.when(F.col("o_orderkey") % 3 == 0, F.lit("US")).alias("country"))


STREAM_NOW = dt.datetime(2024, 1, 31)
RUN_DAYS = 7


def scrape_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event postings tagged with the weekly scrape run they arrive in."""
    ep = event_postings(spark, sf_dir).drop("first_seen")
    run = F.floor(F.datediff(F.to_date("scraped_at"), F.lit("2024-01-01").cast("date")) / RUN_DAYS).cast("int")
    return ep.withColumn("run", run)
