"""Raw platform responses derived from customer ⋈ orders.

Every customer is a tracked company on one of the seven platforms; its orders
(the stand-in postings) are served back as that platform's payload — JSON for
the APIs, a sitemap for iCIMS, an HTML page with an embedded blob for
Paylocity — split into pages of at most 20 postings. The normalisers then
parse these bodies back into postings. Status codes come from the account
balance (dead, gone, throttled, alive).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import presets
from ..operators.geo import gazetteer_maps
from ..operators.quality import live_companies
from ..session import landed, materialize, read_table
from ..sources.raw import normalize_run
from . import fixtures as fx

PAGE_SIZE = 20
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _platform(custkey: Column) -> Column:
    out = None
    for i, p in enumerate(presets.PLATFORMS):
        out = F.when(custkey % 7 == i, p) if out is None else out.when(custkey % 7 == i, p)
    return out


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, platform, slug, name, status, content_type) per customer."""
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    plat = _platform(k)
    base = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))
    guid = F.lower(F.concat(F.lpad(F.hex(k), 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(F.hex(k * 7919), 12, "0")))
    slug = (F.when(plat == "Workday", F.concat(base, F.lit("|wd"), ((F.col("c_nationkey") % 5) + 1).cast("string"),
                                               F.lit("|careers")))
            .when(plat == "Paylocity", guid).otherwise(base))
    name = (F.when(plat != "Paylocity", F.lit(None))
            .when(F.col("c_nationkey") % 4 == 0, F.concat(F.col("c_name"), F.lit(" &amp; Sons")))
            .when(F.col("c_nationkey") % 4 == 1, F.lit(None)).otherwise(F.col("c_name")))
    bal = F.col("c_acctbal")
    status = (F.when(bal < -800, 404).when(bal < -600, 410).when(bal < -400, 429).otherwise(200))
    ctype = F.when((plat == "BambooHR") & (bal >= 0) & (bal < 300), "text/html").otherwise("application/json")
    return c.select("c_custkey", "c_nationkey", "c_acctbal", plat.alias("platform"), slug.alias("slug"),
                    name.cast("string").alias("name"), status.alias("status"), ctype.alias("content_type"))


# Companies already known dead before this run (a subset of the 404s).
DEAD_BALANCE = -900


def known_dead(spark: SparkSession, sf: str) -> DataFrame:
    return companies(spark, sf).filter(F.col("c_acctbal") < DEAD_BALANCE).select("platform", "slug")


def _job_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Postings per company with a page number (20 per page, by order key)."""
    j = fx.jobs_view(spark, sf).select("job_id", "title", "location", "remote", "url", "updated_at",
                                       "first_seen", F.col("scraped_at").alias("order_date"),
                                       F.col("company").alias("c_name"))
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("c_custkey"))
    w = Window.partitionBy("c_custkey").orderBy("job_id")
    return (j.join(o, "job_id")
            .withColumn("page", ((F.row_number().over(w) - 1) / PAGE_SIZE).cast("int"))
            .withColumn("n_jobs", F.count(F.lit(1)).over(Window.partitionBy("c_custkey"))))


def _city_state(loc: Column) -> tuple[Column, Column]:
    parts = F.split(loc, ", ")
    return parts[0], F.when(F.size(parts) > 1, parts[1])


def _title_slug(title: Column) -> Column:
    """URL path segment: lower, spaces to dashes, '/' and '&' percent-encoded."""
    t = F.lower(title)
    t = F.replace(F.replace(t, F.lit("/"), F.lit("%2F")), F.lit("&"), F.lit("%26"))
    return F.replace(t, F.lit(" "), F.lit("-"))


def _posting(platform: str) -> Column:
    """One posting in the platform's own JSON / XML shape."""
    title, loc, okey = F.col("title"), F.col("location"), F.col("job_id")
    upd = F.date_format("updated_at", ISO)
    if platform == "Greenhouse":
        return F.struct(title.alias("title"), F.struct(loc.alias("name")).alias("location"),
                        F.col("url").alias("absolute_url"),
                        F.array(F.struct(F.when(okey % 3 == 0, "Engineering").otherwise("Operations").alias("name")))
                        .alias("departments"),
                        okey.alias("id"), upd.alias("updated_at"))
    if platform == "Ashby":
        return F.struct(okey.cast("string").alias("id"), title.alias("title"),
                        F.when(okey % 7 == 0, F.concat(loc, F.lit(" / Hybrid office, second floor, building C")))
                        .otherwise(loc).alias("locationName"))
    if platform == "BambooHR":
        city, state = _city_state(loc)
        own = [okey.cast("string").alias("id"), title.alias("jobOpeningName")]
        whole = F.concat(loc, F.lit(" (main campus, north entrance, third floor)"))
        return F.when(okey % 4 == 1, F.to_json(F.struct(*own, whole.alias("location")))) \
            .otherwise(F.to_json(F.struct(*own, F.struct(city.alias("city"), state.alias("state")).alias("location"))))
    if platform == "Lever":
        return F.struct(title.alias("text"), F.concat(F.lit("https://jobs.lever.example/"), okey.cast("string"))
                        .alias("hostedUrl"), F.struct(loc.alias("location")).alias("categories"))
    if platform == "Workday":
        days = F.datediff(F.to_date(F.lit(fx.JOBS_NOW.date().isoformat())), F.to_date("order_date"))
        posted = F.when(days == 0, "Posted Today").otherwise(F.concat(F.lit("Posted "), days.cast("string"),
                                                                      F.lit(" Days Ago")))
        return F.struct(title.alias("title"), F.concat(F.lit("/jobs/"), okey.cast("string"), F.lit("/"),
                                                        _title_slug(title)).alias("externalPath"),
                        loc.alias("locationsText"), posted.alias("postedOn"))
    if platform == "Paylocity":
        city, state = _city_state(loc)
        return F.struct(F.when(okey % 6 != 0, okey).alias("JobId"),
                        F.when(okey % 13 == 0, F.concat(title, F.lit(" &amp; Ops"))).otherwise(title).alias("JobTitle"),
                        F.lit("Main").alias("LocationName"),
                        F.struct(city.alias("City"), state.alias("State")).alias("JobLocation"),
                        (okey % 10 == 3).alias("IsRemote"),
                        F.when(okey % 5 == 0, "R&amp;D").alias("HiringDepartment"),
                        F.date_format("updated_at", ISO).alias("PublishedDate"))
    raise KeyError(platform)


def _icims_url(slug: Column) -> Column:
    return F.concat(F.lit("<url><loc>https://careers-"), slug, F.lit(".icims.com/jobs/"), F.col("job_id").cast("string"),
                    F.lit("/"), _title_slug(F.col("title")), F.lit("/job</loc><lastmod>"),
                    F.coalesce(F.date_format("updated_at", "yyyy-MM-dd"), F.lit("")), F.lit("</lastmod></url>"))


INPUTS = ["orders", "customer", "nation", "supplier"]


def gazetteer(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return landed(spark, sf, "gazetteer", INPUTS, lambda: gazetteer_maps(fx.gazetteer(spark, sf)))


def all_responses(spark: SparkSession, sf: str) -> DataFrame:
    """The landed responses of every tracked company."""
    return landed(spark, sf, "raw", INPUTS, lambda: raw_responses(spark, sf))


def raw_responses(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """(platform, slug, status, content_type, page, body, fetched_at): one
    aggregation pass builds every platform's pages; the result is landed once,
    a partition for each platform, so each normaliser reads its own partition.
    ``only`` = companies(platform, slug) that are fetched at all."""
    comp = companies(spark, sf)
    if only is not None:
        comp = comp.join(only.select("platform", "slug"), ["platform", "slug"], "left_semi")
    jobs = _job_rows(spark, sf)
    base = comp.join(jobs, "c_custkey", "left")
    base = base.withColumn("page", F.coalesce("page", F.lit(0))).withColumn("n_jobs", F.coalesce("n_jobs", F.lit(0)))
    has = F.col("job_id").isNotNull()
    plat = F.col("platform")
    item = None
    for p in presets.PLATFORMS:
        expr = _icims_url(F.col("slug")) if p == "iCIMS" else _posting(p) if p == "BambooHR" else F.to_json(_posting(p))
        item = F.when(plat == p, expr) if item is None else item.when(plat == p, expr)
    g = base.groupBy("platform", "slug", "status", "content_type", "c_custkey", "page", "n_jobs").agg(
        F.array_join(F.collect_list(F.when(has, item)), ",").alias("items"),
        F.array_join(F.collect_list(F.when(has, item)), "").alias("xml_items"))
    items = F.col("items")
    total = F.when((F.col("c_custkey") % 11 == 0) & (F.col("page") >= 1), F.col("n_jobs") + 1).otherwise(F.col("n_jobs"))
    sitemap_extra = F.concat(F.lit("<url><loc>https://careers-"), F.col("slug"), F.lit(".icims.com/jobs/intro</loc></url>"),
                             F.lit("<url><loc>https://careers-"), F.col("slug"), F.lit(".icims.com/about</loc></url>"))
    blob = F.concat(F.lit('{"Jobs":['), items, F.lit("]}"))
    body = (F.when(plat == "Greenhouse", F.concat(F.lit('{"jobs":['), items, F.lit("]}")))
            .when(plat == "Ashby", F.concat(F.lit('{"data":{"jobBoard":{"jobPostings":['), items, F.lit("]}}}")))
            .when(plat == "BambooHR", F.when(F.col("content_type") == "text/html", F.lit("<html>login</html>"))
                  .otherwise(F.concat(F.lit('{"result":['), items, F.lit("]}"))))
            .when(plat == "Lever", F.concat(F.lit("["), items, F.lit("]")))
            .when(plat == "Workday", F.concat(F.lit('{"total":'), total.cast("string"), F.lit(',"jobPostings":['), items,
                                              F.lit("]}")))
            .when(plat == "iCIMS", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
                                            sitemap_extra, F.col("xml_items"), F.lit("</urlset>")))
            .otherwise(F.when(F.col("c_custkey") % 13 == 5, F.lit("<html><body>maintenance</body></html>"))
                       .when(F.col("c_custkey") % 13 == 7,
                             F.lit("<html><script>window.pageData = {Jobs: [};</script></html>"))
                       .otherwise(F.concat(F.lit("<html><head><script>window.pageData = "), blob,
                                           F.lit(";</script></head></html>")))))
    ok = F.col("status") == 200
    raw = g.filter(ok | (F.col("page") == 0)).select(
        "platform", "slug", "status", "content_type", "page",
        F.when(ok, body).otherwise(F.lit("")).alias("body"),
        fx.ts_lit(fx.JOBS_NOW).alias("fetched_at"))
    return materialize(raw, "raw", partition_by="platform")


def run_postings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """This run: tracked companies, live ones, their landed responses, and the postings
    of these, normalised and written once; all statistics read them."""
    return landed(spark, sf, "run", INPUTS, lambda: _run(spark, sf))


def _run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    comp = companies(spark, sf)
    live = live_companies(comp, known_dead(spark, sf))
    raw = raw_responses(spark, sf, live)
    maps = gazetteer(spark, sf)
    postings = normalize_run(raw, maps, comp.select("slug", "name"), scraped_at=fx.ts_lit(fx.JOBS_NOW))
    return comp, live, raw, materialize(postings, "postings")
