"""Registered queries: a whole run, each step fed by the one before, and the files
that carry state from run to run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import presets
from ..functions.classify import dedup_key
from ..operators import clean as C
from ..operators import merge as M
from ..operators import salary as SA
from ..operators import shortlist as SL
from ..operators import trends as TR
from ..session import materialize
from ..sources import chunks as CH
from ..sources import run_files as RF
from ..sources.trends import new_snapshot_dir
from . import fixtures as fx
from . import raw_fixture as rf
from . import sqlgen as g
from .q_lookup import _CLEAN, _FK, _PK, _SAL_AGG, _SHORT, BASE, DEAD_SQL, salary_tables
from .q_search import jobs
from .registry import register

NOW = fx.JOBS_NOW
BEFORE = NOW - dt.timedelta(days=10)
LONG_AGO = NOW - dt.timedelta(days=60)
CHUNK = 500

_KEY = """CASE WHEN ats = 'Workday' AND regexp_extract(coalesce(url, ''), '/jobs/(\\d+)', 1) <> ''
   THEN concat('workday:', coalesce(company, ''), ':', regexp_extract(coalesce(url, ''), '/jobs/(\\d+)', 1))
  WHEN ats = 'Paylocity' AND nullif(id, '') IS NOT NULL THEN concat('paylocity:', id)
  WHEN ats = 'Paylocity' THEN concat('paylocity:', coalesce(company, ''), ':', coalesce(title, ''))
  ELSE coalesce(url, '') END"""


@register("pipeline_run", f"""{BASE},
kept AS (SELECT *, {_KEY} AS key FROM nj WHERE {_CLEAN}),
prim AS (SELECT {_PK} AS key, {_SAL_AGG} FROM jobs_c WHERE salary_median IS NOT NULL GROUP BY 1),
fall AS (SELECT {_FK} AS key, {_SAL_AGG} FROM jobs_c WHERE salary_median IS NOT NULL GROUP BY 1),
sal AS (SELECT k.key, k.url, k.title, coalesce(p.median, f.median) AS median FROM kept k
 LEFT JOIN prim p ON {_PK.replace('company', 'k.company').replace('title', 'k.title').replace('skill_level', 'k.skill_level')} = p.key
 LEFT JOIN fall f ON {_FK.replace('title', 'k.title').replace('skill_level', 'k.skill_level')} = f.key),
old AS (SELECT DISTINCT key, length(key) % 4 = 0 AS stale FROM kept WHERE length(key) % 2 = 0),
live_old AS (SELECT key FROM old WHERE NOT stale),
merged AS (SELECT DISTINCT k.key, o.key IS NOT NULL AS known FROM kept k LEFT JOIN live_old o ON o.key = k.key),
n AS (SELECT count(*) AS n, count(*) FILTER (known) AS known FROM merged)
SELECT 'postings' AS stage, count(*) AS n, CAST(sum(length(url)) AS BIGINT) AS checksum FROM nj
UNION ALL SELECT 'clean', count(*), CAST(sum(length(title)) AS BIGINT) FROM kept
UNION ALL SELECT 'salary', count(median), CAST(sum(median) AS BIGINT) FROM sal
UNION ALL SELECT 'merge', n, n - known FROM n
UNION ALL SELECT 'new_jobs', (SELECT count(*) FROM kept WHERE key NOT IN (SELECT key FROM live_old)), known FROM n
UNION ALL SELECT 'trend', n, (SELECT count(*) FROM merged WHERE key LIKE 'workday:%') FROM n
UNION ALL SELECT 'publish', (SELECT CAST(ceil(n / {CHUNK}.0) AS BIGINT) FROM n), n FROM n""")
def q_pipeline_run(spark, sf):
    """Responses -> postings -> clean -> salary -> merge -> trend row -> published
    chunks, read back. One row a stage: its rows and a checksum (first sightings for
    the merge, kept first sightings for new_jobs)."""
    _, _, _, postings = rf.run_postings(spark, sf)
    kept, _ = C.clean(postings)
    # classified once for both tables of salaries
    paid = materialize(jobs(spark, sf).select("company", "title", "skill_level", "salary_median"), "paid")
    prim, fall = salary_tables(spark, sf, paid)
    priced = SA.enrich_salary(kept, prim, fall).withColumn("key", dedup_key("url", "ats", "company", "id", "title"))
    priced = materialize(priced.withColumn("seq", F.monotonically_increasing_id()), "priced")
    # the standing dataset: some of these postings, seen before; half of them too long ago
    old = priced.where(F.length("key") % 2 == 0).withColumn(
        "scraped_at", F.when(F.length("key") % 4 == 0, fx.ts_lit(LONG_AGO)).otherwise(fx.ts_lit(BEFORE))).withColumn("first_seen", F.col("scraped_at"))
    merged, new_count = M.merge(old, priced, NOW)
    merged = materialize(merged, "merged")
    trend = TR.trend_snapshot(merged, NOW.date())
    manifest, problems = CH.publish(CH.slim(merged, keep=["key"]), new_snapshot_dir(spark, "run"), "r1", tie="key", size=CHUNK,
                                    metadata={"total_jobs": merged.count()})
    assert problems.isEmpty()

    def row(stage, df, n, checksum):
        return df.agg(F.lit(stage).alias("stage"), n.cast("bigint").alias("n"), checksum.cast("bigint").alias("checksum"))

    count, first = F.count(F.lit(1)), F.col("first_seen") == fx.ts_lit(NOW)
    rows = [row("postings", postings, count, F.sum(F.length("url"))), row("clean", kept, count, F.sum(F.length("title"))),
            row("salary", priced, F.count("salary.median"), F.sum("salary.median")),
            row("merge", merged, count, F.count_if(first)), row("new_jobs", new_count.join(merged.agg(F.count_if(~first).alias("known")), F.lit(True)),
                                                               F.max("new_count"), F.max("known")),
            row("trend", trend, F.max("total_jobs"), F.max(F.element_at("by_platform", "workday"))),
            row("publish", spark.createDataFrame([(len(manifest["chunks"]), manifest["totalJobs"])], "c long, t long"), F.max("c"), F.max("t"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@register("dead_files", f"{BASE}\n{DEAD_SQL}")
def q_dead_files(spark, sf):
    """Dead-slug lists, written and read back."""
    return RF.read_dead(spark, RF.write_dead(rf.known_dead(spark, sf), new_snapshot_dir(spark, "dead"), slugs_per_file=20))


@register("shortlist_file", f"""{BASE},
sl AS ({_SHORT})
SELECT platform, slug, (SELECT count(*) FROM nj WHERE {g.role_match('title', 'skill_level')}) AS matched_jobs,
 {g.q(presets.ROLE_PRESET.get('name', ''))} AS preset, {g.q(','.join(sorted(presets.ROLE_PRESET.get('levels') or [])))} AS levels FROM sl""")
def q_shortlist_file(spark, sf):
    """The shortlist, written as its file and read back."""
    _, _, _, postings = rf.run_postings(spark, sf)
    path = RF.write_shortlist(*SL.build_shortlist(postings), new_snapshot_dir(spark, "shortlist"), NOW)
    slugs, about = RF.read_shortlist(spark, path)
    return slugs.join(about, F.lit(True)).select("platform", "slug", "matched_jobs", "preset", F.array_join("levels", ",").alias("levels"))
