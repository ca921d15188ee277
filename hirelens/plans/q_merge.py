"""Registered queries: merge keys, relative dates, retention, last-wins dedupe,
overlay with first_seen, new-key counts, status upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import presets
from ..functions.classify import relative_date
from ..operators import bucket_merge as BM
from ..operators import merge as M
from ..session import read_table
from ..sources.trends import new_snapshot_dir
from . import fixtures as fx
from . import sqlgen as g
from .registry import register

NOW = fx.EVENTS_NOW
WE = "WITH " + g.event_postings_cte()
_STALE = f"coalesce({g.age_us('scraped_at', NOW)} >= {(presets.RETENTION_DAYS + 1) * 86400000000}, false)"
_MERGE_CTES = f"""{WE},
exk AS (SELECT * FROM ex WHERE key <> '' AND NOT {_STALE}),
exd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM exk) WHERE rn = 1),
nwk AS (SELECT * FROM nw WHERE key <> ''),
nwd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM nwk) WHERE rn = 1),
merged AS (
 SELECT n.key, n.seq, n.ats, n.company, n.url, n.id, n.title, n.scraped_at,
  CASE WHEN e.key IS NOT NULL THEN e.first_seen ELSE n.scraped_at END AS first_seen
 FROM nwd n LEFT JOIN exd e ON n.key = e.key
 UNION ALL
 SELECT e.key, e.seq, e.ats, e.company, e.url, e.id, e.title, e.scraped_at, e.first_seen
 FROM exd e WHERE NOT EXISTS (SELECT 1 FROM nwd n WHERE n.key = e.key))"""


def _merge(spark, sf):
    ex = fx.existing_load(spark, sf)
    nw = fx.new_load(spark, sf)
    return M.merge(ex, nw, NOW)


@register("dedup_key", f"{WE}\nSELECT seq, ats, url, id, key FROM ep")
def q_dedup_key(spark, sf):
    return fx.event_postings(spark, sf).select("seq", "ats", "url", "id", "key")


_POSTED_TEXT = """CASE event_type WHEN 'view' THEN 'Posted Today'
 WHEN 'click' THEN concat('Posted ', CAST(user_id % 30 AS VARCHAR), ' Days Ago')
 WHEN 'purchase' THEN concat('Posted ', CAST(user_id % 5 AS VARCHAR), ' Weeks Ago')
 WHEN 'signup' THEN concat('Posted ', CAST(user_id % 3 AS VARCHAR), ' Months Ago')
 ELSE concat('Posted ', CAST(user_id % 30 AS VARCHAR), '+ Days Ago') END"""


@register("relative_date", f"""SELECT event_id, posted_text, CAST(ts AS DATE) AS run_date,
 CASE WHEN contains(t, 'today') THEN CAST(ts AS DATE)
  WHEN regexp_extract(t, '(\\d+)\\s+day', 1) <> '' THEN CAST(ts AS DATE) - CAST(regexp_extract(t, '(\\d+)\\s+day', 1) AS INT)
  WHEN regexp_extract(t, '(\\d+)\\s+week', 1) <> '' THEN CAST(ts AS DATE) - 7 * CAST(regexp_extract(t, '(\\d+)\\s+week', 1) AS INT)
  WHEN regexp_extract(t, '(\\d+)\\s+month', 1) <> '' THEN CAST(ts AS DATE) - 30 * CAST(regexp_extract(t, '(\\d+)\\s+month', 1) AS INT)
 END AS posted_date
FROM (SELECT *, {_POSTED_TEXT} AS posted_text, lower(trim({_POSTED_TEXT})) AS t FROM events) e""")
def q_relative_date(spark, sf):
    e = read_table(spark, sf, "events")
    uid = F.col("user_id")
    text = (F.when(F.col("event_type") == "view", F.lit("Posted Today"))
            .when(F.col("event_type") == "click", F.concat(F.lit("Posted "), (uid % 30).cast("string"), F.lit(" Days Ago")))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("Posted "), (uid % 5).cast("string"), F.lit(" Weeks Ago")))
            .when(F.col("event_type") == "signup", F.concat(F.lit("Posted "), (uid % 3).cast("string"), F.lit(" Months Ago")))
            .otherwise(F.concat(F.lit("Posted "), (uid % 30).cast("string"), F.lit("+ Days Ago"))))
    run_date = F.to_date("ts")
    t = e.select("event_id", text.alias("posted_text"), run_date.alias("run_date"))
    return t.withColumn("posted_date", relative_date("posted_text", F.col("run_date")))


@register("retention_30d", f"{WE}\nSELECT seq, key, scraped_at FROM ex WHERE NOT {_STALE}")
def q_retention(spark, sf):
    return M.retain(fx.existing_load(spark, sf), "scraped_at", NOW).select("seq", "key", "scraped_at")


@register("stale_count", f"{WE}\nSELECT CAST(count_if({_STALE}) AS BIGINT) AS stale_count FROM ex WHERE key <> ''")
def q_stale_count(spark, sf):
    return M.stale_count(fx.existing_load(spark, sf), "key", "scraped_at", NOW)


_LI_SEQ = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@register("dedup_last", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LI_SEQ.split(', '))}) AS rn
 FROM lineitem) t WHERE rn = 1""")
def q_dedup_last(spark, sf):
    li = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    d = M.dedup_last(li, ["l_orderkey", "l_linenumber"], _LI_SEQ.split(", "))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag")


@register("merge_first_seen", f"{_MERGE_CTES}\nSELECT * FROM merged")
def q_merge_first_seen(spark, sf):
    merged, _ = _merge(spark, sf)
    return merged.select("key", "seq", "ats", "company", "url", "id", "title", "scraped_at", "first_seen")


def _bucketed(spark, sf, existing=None, new=None):
    """The existing load as a bucketed dataset's first version, the new one merged onto it."""
    root = new_snapshot_dir(spark, "buckets")
    BM.load(spark, root, fx.existing_load(spark, sf) if existing is None else existing, 16, now=NOW, locality=BM.company_of)
    return root, BM.merge(spark, root, fx.new_load(spark, sf) if new is None else new, NOW, locality=BM.company_of)


@register("merge_buckets", f"{_MERGE_CTES}\nSELECT * FROM merged")
def q_merge_buckets(spark, sf):
    """merge_first_seen, of which only the buckets that the new load meets are rewritten."""
    root, _ = _bucketed(spark, sf)
    return BM.read(spark, root).select("key", "seq", "ats", "company", "url", "id", "title", "scraped_at", "first_seen")


_DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(scraped_at AS DATE)) AS INT)"


@register("merge_bucket_days", f"""{WE}, d AS (SELECT key, {_DAY} AS day FROM ep WHERE key <> ''),
f AS (SELECT key, min(day) AS first FROM d GROUP BY key)
SELECT d.day, count(*) FILTER (WHERE d.day = f.first) AS new_jobs,
 (SELECT count(*) FROM f AS g WHERE g.first <= d.day) AS total_jobs FROM d JOIN f ON d.key = f.key
WHERE d.day % 10 = 3 GROUP BY d.day""")
def q_merge_bucket_days(spark, sf):
    """The scrape log merged onto a bucketed dataset, split after every tenth day from the third on: what the day's own
    run adds, and how many postings there are after it. Earlier versions are read beside later ones."""
    day = F.datediff(F.to_date("scraped_at"), F.lit("2024-01-01").cast("date"))
    log = fx.event_postings(spark, sf).drop("first_seen").withColumn("day", day)
    root, out = new_snapshot_dir(spark, "bucket-days"), None
    last = -1
    for d in (3, 13, 23):  # the log covers 30 days, whatever its size
        BM.merge(spark, root, log.filter((F.col("day") > last) & (F.col("day") < d)).drop("day"), fx.STREAM_NOW, buckets=16, locality=BM.company_of, keep=10)
        m = BM.merge(spark, root, log.filter(F.col("day") == d).drop("day"), fx.STREAM_NOW, locality=BM.company_of, keep=10)
        total = BM.read(spark, root, m.version).agg(F.count(F.lit(1)).alias("total_jobs"))
        row = total.select(F.lit(d).alias("day"), F.lit(m.new_count).cast("long").alias("new_jobs"), "total_jobs")
        out, last = row if out is None else out.union(row), d
    return out


@register("merge_schema_drift", f"""{_MERGE_CTES}
SELECT m.key, m.title, CASE WHEN n.key IS NULL THEN length(m.company) END AS name_len,
 CASE WHEN n.key IS NOT NULL THEN upper(m.ats) END AS platform_code, m.first_seen
FROM merged m LEFT JOIN nwd n ON n.key = m.key""")
def q_merge_schema_drift(spark, sf):
    """The existing data has a column that the new load lacks, and the other way round."""
    ex = fx.existing_load(spark, sf).withColumn("name_len", F.length("company").cast("bigint"))
    nw = fx.new_load(spark, sf).withColumn("platform_code", F.upper("ats"))
    merged, _ = M.merge(ex, nw, NOW)
    return merged.select("key", "title", "name_len", "platform_code", "first_seen")


@register("merge_metadata", f"""{_MERGE_CTES}
SELECT (SELECT count(*) FROM merged) AS total_jobs,
 (SELECT count(*) FROM nwk WHERE NOT EXISTS (SELECT 1 FROM exk WHERE exk.key = nwk.key)) AS new_jobs,
 '{NOW.strftime('%Y-%m-%dT%H:%M:%SZ')}' AS last_updated""")
def q_merge_metadata(spark, sf):
    merged, n = _merge(spark, sf)
    return M.merge_metadata(merged, n, NOW)


@register("new_job_count", f"""{_MERGE_CTES}
SELECT count(*) AS new_count FROM nwk WHERE NOT EXISTS (SELECT 1 FROM exk WHERE exk.key = nwk.key)""")
def q_new_job_count(spark, sf):
    _, n = _merge(spark, sf)
    return n


@register("new_job_count_anti", f"""{WE},
exk AS (SELECT * FROM ex WHERE key <> '' AND NOT {_STALE})
SELECT count(*) AS new_count FROM nw WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM exk WHERE exk.key = nw.key)""")
def q_new_job_count_anti(spark, sf):
    kept = M.retain(fx.existing_load(spark, sf), "scraped_at", NOW)
    return M.count_new(kept, fx.new_load(spark, sf))


@register("merge_after_prune", f"""{_MERGE_CTES}
SELECT m.key, m.scraped_at, m.first_seen FROM merged m
WHERE EXISTS (SELECT 1 FROM ex WHERE ex.key = m.key AND {_STALE.replace('scraped_at', 'ex.scraped_at')})
 AND NOT EXISTS (SELECT 1 FROM exk WHERE exk.key = m.key)
 AND EXISTS (SELECT 1 FROM nwk WHERE nwk.key = m.key)""")
def q_merge_after_prune(spark, sf):
    ex = fx.existing_load(spark, sf)
    merged, _ = _merge(spark, sf)
    pruned = ex.filter(M.stale_flag(ex, "scraped_at", NOW)).select("key")
    kept = M.retain(ex, "scraped_at", NOW).select("key")
    nw = fx.new_load(spark, sf).select("key")
    return (merged.join(pruned, "key", "left_semi").join(kept, "key", "left_anti").join(nw, "key", "left_semi")
            .select("key", "scraped_at", "first_seen"))


@register("status_upsert", f"""WITH {g.status_cte()},
ch AS (SELECT concat('https://example.com/jobs/', l_orderkey) AS url,
  CASE l_returnflag WHEN 'R' THEN 'applied' WHEN 'A' THEN 'ignored' ELSE 'saved' END AS status,
  CAST(l_shipdate AS DATE) AS date, ((epoch_us(l_shipdate) // 86400000000) * 8 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq FROM lineitem),
u AS (SELECT url, status, date, 0 AS side, NULL::BIGINT AS seq FROM status
      UNION ALL SELECT url, status, date, 1 AS side, seq FROM ch)
SELECT url, status, date FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY side DESC, seq DESC NULLS FIRST, status DESC) AS rn FROM u) t
WHERE rn = 1""")
def q_status_upsert(spark, sf):
    st = fx.status_table(spark, sf)
    ch = fx.status_changes(spark, sf).select("url", "status", "date", "seq")
    return M.upsert_status(st, ch)


@register("status_delete", f"""WITH {g.status_cte()}
SELECT url, status, date FROM status s
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R'
  AND concat('https://example.com/jobs/', l.l_orderkey) = s.url)""")
def q_status_delete(spark, sf):
    """Remove the stored status of every URL that has a returned line item."""
    st = fx.status_table(spark, sf)
    li = read_table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    urls = li.select(F.concat(F.lit("https://example.com/jobs/"), F.col("l_orderkey").cast("string")).alias("url"))
    return M.delete_status(st, urls)
