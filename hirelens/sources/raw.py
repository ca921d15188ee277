"""Platform normalisers: a table of raw responses in, postings out.

Input columns: ``platform, slug, status, content_type, page, body, fetched_at``
(one row per fetched page). Every parser is a Spark job — ``from_json`` /
``from_xml`` / ``regexp_extract`` on the body, ``explode`` of the posting
array, column rules — so parsing is spread over the cluster by response and
nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.classify import is_recruiter, relative_date, tier_of_score, tier_score
from ..functions.text import blank_to_null, html_unescape, url_title
from ..operators.geo import enrich_postings

CUT = presets.LOCATION_CUT

SCHEMAS = {
    "Greenhouse": "jobs ARRAY<STRUCT<title: STRING, location: STRUCT<name: STRING>, absolute_url: STRING, "
                  "departments: ARRAY<STRUCT<name: STRING>>, id: BIGINT, updated_at: STRING>>",
    "Ashby": "data STRUCT<jobBoard: STRUCT<jobPostings: ARRAY<STRUCT<id: STRING, title: STRING, locationName: STRING>>>>",
    "BambooHR": "result ARRAY<STRUCT<id: STRING, jobOpeningName: STRING, location: STRING>>",
    "Lever": "ARRAY<STRUCT<text: STRING, hostedUrl: STRING, categories: STRUCT<location: STRING>>>",
    "Workday": "total BIGINT, jobPostings ARRAY<STRUCT<title: STRING, externalPath: STRING, locationsText: STRING, "
               "postedOn: STRING>>",
    "iCIMS": "url ARRAY<STRUCT<loc: STRING, lastmod: STRING>>",
    "Paylocity": "Jobs ARRAY<STRUCT<JobId: BIGINT, JobTitle: STRING, LocationName: STRING, "
                 "JobLocation: STRUCT<City: STRING, State: STRING>, IsRemote: BOOLEAN, HiringDepartment: STRING, "
                 "PublishedDate: STRING, Description: STRING>>",
}
PAGEDATA = r"(?s)window\.pageData\s*=\s*(\{.*?\});\s*</script>"
JOB_COLS = ["company", "company_slug", "title", "location", "location_full", "lookup", "url", "absolute_url", "departments", "id",
            "updated_at", "remote_flag", "is_recruiter", "ats", "skill_level", "slug", "page"]


def _ok(raw: DataFrame, platform: str) -> DataFrame:
    return raw.filter((F.col("platform") == platform) & (F.col("status") == 200))


def _place(full: Column, cut: bool = True, look_up_full: bool = False) -> list[Column]:
    """location (cut on some platforms), location_full (the whole text), lookup (what
    the gazetteer is asked for)."""
    shown = F.substring(full, 1, CUT) if cut else full
    return [shown.alias("location"), full.alias("location_full"), (full if look_up_full else shown).alias("lookup")]


def _finish(df: DataFrame, ats: str, recruiter_of: Column | None = None) -> DataFrame:
    """Common tail: tier of the title, recruiter flag, platform name, fixed columns."""
    out = (df.withColumn("ats", F.lit(ats)).withColumn("_tier_score", tier_score("title"))
           .withColumn("skill_level", tier_of_score(F.col("_tier_score"))).drop("_tier_score"))
    out = out.withColumn("is_recruiter", is_recruiter(recruiter_of if recruiter_of is not None else F.col("slug")))
    for c in JOB_COLS:
        if c not in out.columns:
            dtype = "array<string>" if c == "departments" else ("boolean" if c == "remote_flag" else "string")
            out = out.withColumn(c, F.lit(None).cast(dtype))
    return out.select(*JOB_COLS)


def normalize_greenhouse(raw: DataFrame) -> DataFrame:
    p = _ok(raw, "Greenhouse").select("slug", "page", F.from_json("body", SCHEMAS["Greenhouse"]).alias("b"))
    j = p.select("slug", "page", F.explode("b.jobs").alias("j"))
    return _finish(j.select(
        "slug", "page", F.col("slug").alias("company"), F.col("slug").alias("company_slug"),
        F.col("j.title").alias("title"),
        *_place(F.coalesce(F.col("j.location.name"), F.lit("Not specified")), cut=False),
        F.col("j.absolute_url").alias("url"), F.col("j.absolute_url").alias("absolute_url"),
        F.transform("j.departments", lambda d: d["name"]).alias("departments"),
        F.col("j.id").cast("string").alias("id"), F.col("j.updated_at").alias("updated_at")), "Greenhouse")


def normalize_ashby(raw: DataFrame) -> DataFrame:
    p = _ok(raw, "Ashby").select("slug", "page", F.from_json("body", SCHEMAS["Ashby"]).alias("b"))
    j = p.select("slug", "page", F.explode("b.data.jobBoard.jobPostings").alias("j"))
    return _finish(j.select(
        "slug", "page", F.col("slug").alias("company"), F.col("slug").alias("company_slug"),
        F.coalesce(F.col("j.title"), F.lit("")).alias("title"),
        *_place(F.coalesce(F.col("j.locationName"), F.lit("Not specified"))),
        F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("slug"), F.lit("/"),
                 F.coalesce(F.col("j.id"), F.lit("None"))).alias("url")), "Ashby")


def normalize_bamboohr(raw: DataFrame) -> DataFrame:
    """A 200 reply that is not JSON counts as 404 (see ``effective_status``). A location
    is an object of city and state, or plain text."""
    p = (_ok(raw, "BambooHR").filter(F.coalesce(F.col("content_type"), F.lit("")).contains("application/json"))
         .select("slug", "page", F.from_json("body", SCHEMAS["BambooHR"]).alias("b")))
    j = p.select("slug", "page", F.explode("b.result").alias("j"))
    place = F.from_json("j.location", "city STRING, state STRING")  # an object comes as its JSON text
    joined = F.concat_ws(", ", blank_to_null(place["city"]), blank_to_null(place["state"]))
    text = F.when(F.col("j.location").startswith("{"), joined).otherwise(F.col("j.location"))
    loc = F.coalesce(blank_to_null(text), F.lit("Not specified"))
    return _finish(j.select(
        "slug", "page", F.col("slug").alias("company"), F.col("slug").alias("company_slug"),
        F.col("j.jobOpeningName").alias("title"), *_place(loc, look_up_full=True),
        F.concat(F.lit("https://"), F.col("slug"), F.lit(".bamboohr.com/careers/"),
                 F.coalesce(F.col("j.id"), F.lit("None"))).alias("url")), "BambooHR")


def normalize_lever(raw: DataFrame) -> DataFrame:
    p = _ok(raw, "Lever").select("slug", "page", F.from_json("body", SCHEMAS["Lever"]).alias("b"))
    j = p.select("slug", "page", F.explode("b").alias("j"))
    return _finish(j.select(
        "slug", "page", F.col("slug").alias("company"), F.col("slug").alias("company_slug"),
        F.col("j.text").alias("title"),
        *_place(F.coalesce(F.col("j.categories.location"), F.lit("Not specified"))),
        F.col("j.hostedUrl").alias("url")), "Lever")


def workday_pages(raw: DataFrame) -> DataFrame:
    """Pages of a Workday slug that the pager keeps: in page order, stop at the
    first page that failed, is empty, or reports a different total than the
    first page. Slugs must be ``company|wdN|site``. Only (slug, page, status,
    total, size) are grouped by slug; bodies meet the one cut page of their slug."""
    wd = raw.filter((F.col("platform") == "Workday") & (F.size(F.split("slug", r"\|")) == 3))
    body = F.from_json("body", SCHEMAS["Workday"])
    pages = wd.select("slug", "page", "status", F.when(F.col("status") == 200, body).alias("b")).select(
        "slug", "page", "status", F.col("b.total").alias("total"), F.coalesce(F.size("b.jobPostings"), F.lit(0)).alias("n"))
    firsts = pages.groupBy("slug").agg(F.min_by("total", "page").alias("first_total"))
    bad = ((F.col("status") != 200) | (F.col("n") <= 0)
           | ~F.coalesce(F.col("total") == F.col("first_total"), F.lit(False)))
    cut = pages.join(firsts, "slug").groupBy("slug").agg(F.min(F.when(bad, F.col("page"))).alias("_cut"))
    kept = wd.join(cut, "slug").filter(F.col("_cut").isNull() | (F.col("page") < F.col("_cut")))
    return kept.withColumn("b", body)


def normalize_workday(raw: DataFrame) -> DataFrame:
    p = workday_pages(raw)
    parts = F.split("slug", r"\|")
    company, wd, site = parts[0], parts[1], parts[2]
    base = F.concat(F.lit("https://"), company, F.lit(".wd"), F.replace(wd, F.lit("wd"), F.lit("")),
                    F.lit(".myworkdayjobs.com"))
    j = p.select("slug", "page", "fetched_at", company.alias("company"), base.alias("_base"), site.alias("_site"),
                 F.explode("b.jobPostings").alias("j"))
    run_date = F.to_date("fetched_at")
    return _finish(j.select(
        "slug", "page", "company", F.col("slug").alias("company_slug"), F.col("j.title").alias("title"),
        *_place(F.coalesce(blank_to_null(F.col("j.locationsText")), F.lit("Not specified"))),
        F.concat(F.col("_base"), F.lit("/"), F.col("_site"), F.coalesce(F.col("j.externalPath"), F.lit("")))
        .alias("url"),
        F.date_format(relative_date(F.col("j.postedOn"), run_date), "yyyy-MM-dd").alias("updated_at")),
        "Workday", recruiter_of=F.col("company"))


def normalize_icims(raw: DataFrame) -> DataFrame:
    """Sitemap: job URLs (containing /jobs/, not /jobs/intro) -> title from the
    URL segment; lastmod -> updated_at; location unknown."""
    p = _ok(raw, "iCIMS").select("slug", "page", F.from_xml("body", SCHEMAS["iCIMS"], {"rowTag": "urlset"}).alias("b"))
    u = p.select("slug", "page", F.explode("b.url").alias("u"))
    loc = F.trim(F.coalesce(F.col("u.loc"), F.lit("")))
    keep = (loc != "") & loc.contains("/jobs/") & ~loc.endswith("/jobs/intro")
    t = u.filter(keep).select("slug", "page", loc.alias("url"),
                              F.when(F.trim("u.lastmod") != "", F.trim("u.lastmod")).alias("updated_at"))
    t = t.withColumn("title", url_title("url")).filter(F.col("title").isNotNull())
    return _finish(t.select(
        "slug", "page", F.col("slug").alias("company"), F.col("slug").alias("company_slug"), "title",
        F.lit("Not specified").alias("location"), F.lit("Not specified").alias("location_full"), "url", "updated_at",
        F.lit(False).alias("remote_flag")), "iCIMS")


def extract_blob(body: Column, pattern: str = PAGEDATA) -> Column:
    """The first capture group of ``pattern`` in ``body`` (NULL when absent)."""
    return blank_to_null(F.regexp_extract(body, pattern, 1))


def normalize_paylocity(raw: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """HTML page with ``window.pageData = {...};`` -> Jobs[]. A missing or
    invalid blob yields no postings (the reply still counts as 200).
    ``names`` = DataFrame(slug, name): the tracked company name per GUID."""
    p = _ok(raw, "Paylocity").select("slug", "page", F.from_json(extract_blob(F.col("body")), SCHEMAS["Paylocity"])
                                     .alias("b"))
    if names is not None:
        n = names.select(F.col("slug").alias("_s"), html_unescape(F.col("name")).alias("_name"))
        p = p.join(n, p["slug"] == n["_s"], "left").drop("_s")
    else:
        p = p.withColumn("_name", F.lit(None).cast("string"))
    j = p.select("slug", "page", F.coalesce(blank_to_null(F.col("_name")), F.col("slug")).alias("company"),
                 F.explode("b.Jobs").alias("j"))
    city, state = blank_to_null(F.col("j.JobLocation.City")), blank_to_null(F.col("j.JobLocation.State"))
    raw_loc = (F.when(city.isNotNull() & state.isNotNull(), F.concat(city, F.lit(", "), state))
               .when(city.isNotNull(), city)
               .otherwise(F.coalesce(blank_to_null(F.col("j.LocationName")), F.lit("Not specified"))))
    jid = F.col("j.JobId")
    has_id = jid.isNotNull() & (jid != 0)
    detail = F.when(has_id, F.concat(F.lit("https://recruiting.paylocity.com/recruiting/Jobs/Details/"), jid.cast("string"))) \
        .otherwise(F.concat(F.lit("https://recruiting.paylocity.com/recruiting/jobs/All/"), F.col("slug"), F.lit("/")))
    dept = blank_to_null(F.col("j.HiringDepartment"))
    out = j.select(
        "slug", "page", "company", F.col("slug").alias("company_slug"),
        html_unescape(F.coalesce(F.col("j.JobTitle"), F.lit(""))).alias("title"),
        *_place(html_unescape(raw_loc), cut=False), detail.alias("url"), detail.alias("absolute_url"),
        F.when(dept.isNotNull(), F.array(html_unescape(dept))).otherwise(F.array().cast("array<string>"))
        .alias("departments"),
        jid.cast("string").alias("id"), F.col("j.PublishedDate").alias("updated_at"),
        F.coalesce(F.col("j.IsRemote"), F.lit(False)).alias("remote_flag"))
    return _finish(out, "Paylocity", recruiter_of=F.col("company"))


NORMALIZERS = {
    "Greenhouse": normalize_greenhouse, "Ashby": normalize_ashby, "BambooHR": normalize_bamboohr,
    "Lever": normalize_lever, "Workday": normalize_workday, "iCIMS": normalize_icims,
    "Paylocity": normalize_paylocity,
}


def normalize_all(raw: DataFrame, names: DataFrame | None = None) -> DataFrame:
    outs = [fn(raw, names) if p == "Paylocity" else fn(raw) for p, fn in NORMALIZERS.items()]
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def union_platforms(*dfs: DataFrame, scraped_at: Column, source: str = "automated") -> DataFrame:
    """Union of platform outputs (missing columns -> NULL) plus scrape metadata."""
    res = dfs[0]
    for d in dfs[1:]:
        res = res.unionByName(d, allowMissingColumns=True)
    return res.withColumn("scraped_at", scraped_at).withColumn("source", F.lit(source))


def normalize_run(raw: DataFrame, maps: dict[str, DataFrame], names: DataFrame | None = None, *,
                  scraped_at: Column, source: str = "automated") -> DataFrame:
    """A run's responses -> one table of postings with remote flag, coordinates, country
    and scrape metadata. Worth writing once: every statistic reads it."""
    return enrich_postings(normalize_all(raw, names), maps).withColumn("scraped_at", scraped_at).withColumn("source", F.lit(source))


def effective_status(raw: DataFrame) -> DataFrame:
    """Per fetched slug, the status the fetcher reports: BambooHR non-JSON 200s
    count as 404; a Workday slug of a bad format reports NULL; all others their
    first page's status."""
    st = F.col("status")
    st = F.when((F.col("platform") == "BambooHR") & (st == 200)
                & ~F.coalesce(F.col("content_type"), F.lit("")).contains("application/json"), F.lit(404)).otherwise(st)
    st = F.when((F.col("platform") == "Workday") & (F.size(F.split("slug", r"\|")) != 3), F.lit(None)).otherwise(st)
    r = raw.withColumn("_st", st)
    return r.groupBy("platform", "slug").agg(F.min_by("_st", "page").alias("status"))
