"""Fast-tier shortlist: companies that posted a matching role, per platform;
slug recovery for slim records; shortlist application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.classify import role_match
from ..functions.text import blank_to_null, html_unescape
from ..session import materialize

# Platforms whose company field is the slug itself (the other two need the reverse maps).
SLUG_IS_COMPANY = [p.lower() for p in presets.PLATFORMS if p not in ("Workday", "Paylocity")]


def slug_reverse_maps(companies: DataFrame) -> DataFrame:
    """(platform, company, slug): Workday tenant name (slug part 0) -> slugs,
    Paylocity unescaped display name (else GUID) -> GUIDs. One-to-many."""
    wd = (companies.filter(F.col("platform") == "Workday")
          .select(F.lit("workday").alias("platform"), F.split("slug", r"\|")[0].alias("company"), "slug"))
    name = html_unescape(F.col("name"))
    pl = (companies.filter((F.col("platform") == "Paylocity") & blank_to_null(F.col("slug")).isNotNull())
          .select(F.lit("paylocity").alias("platform"),
                  F.coalesce(blank_to_null(name), F.col("slug")).alias("company"), "slug"))
    return wd.unionByName(pl)


def build_shortlist(jobs: DataFrame, preset=None, reverse: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (shortlist rows (platform, slug) distinct, stats (platform,
    matched_jobs, unresolved)). Postings of an unknown platform (or none) count as
    matched, and are neither listed nor unresolved. A row's slug is its company_slug; slim rows
    (no slug) recover it from the company (five platforms) or the reverse maps."""
    m = jobs.filter(role_match("title", "skill_level", preset)).withColumn("platform", F.lower("ats"))
    if "company_slug" not in m.columns:
        m = m.withColumn("company_slug", F.lit(None).cast("string"))
    m = m.select("platform", "company", "company_slug")
    direct = blank_to_null(F.col("company_slug"))
    m = m.withColumn("_direct", F.when(direct.isNotNull(), direct)
                     .when(F.col("platform").isin(SLUG_IS_COMPANY), blank_to_null(F.col("company"))))
    # the postings are matched once: three steps read their counts, a row a company
    m = materialize(m.groupBy("platform", "company", "_direct").agg(F.count(F.lit(1)).alias("n")), "matched")
    known = m.filter(F.col("platform").isin([p.lower() for p in presets.PLATFORMS]))
    resolved = known.filter(F.col("_direct").isNotNull()).select("platform", F.col("_direct").alias("slug"))
    rest = known.filter(F.col("_direct").isNull())
    if reverse is not None:
        hit = rest.join(reverse, ["platform", "company"], "inner").select("platform", "slug")
        resolved = resolved.unionByName(hit)
        unresolved = rest.join(reverse.select("platform", "company").distinct(), ["platform", "company"], "left_anti")
    else:
        unresolved = rest
    stats = (m.groupBy("platform").agg(F.sum("n").alias("matched_jobs"))
             .join(unresolved.groupBy("platform").agg(F.sum("n").alias("unresolved"))
                   .withColumnRenamed("platform", "_p"), F.col("platform").eqNullSafe(F.col("_p")), "left")
             .select("platform", "matched_jobs", F.coalesce("unresolved", F.lit(0)).alias("unresolved")))
    return resolved.distinct(), stats


def apply_shortlist(companies: DataFrame, shortlist: DataFrame | None) -> DataFrame:
    """Keep companies on the shortlist for their platform; a platform absent from
    the shortlist keeps nothing; no shortlist keeps everything."""
    if shortlist is None:
        return companies
    s = shortlist.select(F.lower("platform").alias("_p"), F.col("slug").alias("_s"))
    return companies.join(s, (F.lower(companies["platform"]) == s["_p"]) & (companies["slug"] == s["_s"]),
                          "left_semi")
