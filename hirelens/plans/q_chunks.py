"""Registered queries: slim projection, chunked publish + manifest, manifest
reader, snapshot validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..sources import chunks as CH
from ..sources.trends import new_snapshot_dir
from .q_search import W, jobs
from .registry import register

SLIM_SCHEMA = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("ats", T.StringType()),
    T.StructField("skill_level", T.StringType()), T.StructField("is_recruiter", T.BooleanType()),
    T.StructField("scraped_at", T.TimestampNTZType()), T.StructField("remote", T.BooleanType()),
    T.StructField("country", T.StringType()), T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("first_seen", T.TimestampNTZType()),
])
SLIM_COLS = ["title", "company", "location", "url", "ats", "skill_level", "is_recruiter", "scraped_at", "remote",
             "country", "updated_at", "first_seen"]
RELEASE = "2001-08-02T00-00-00Z"


def _slim(spark, sf):
    return CH.slim(jobs(spark, sf), keep=["job_id"])


def _published(spark, sf):
    base = new_snapshot_dir(spark, "releases")
    # ranges are drawn from a sample first: classify the postings once, not for it as well
    manifest, problems = CH.publish(materialize(_slim(spark, sf), "slim"), base, RELEASE, tie="job_id", size=SIZE)
    return base, manifest, problems


@register("slim_project", f"{W}\nSELECT {', '.join(SLIM_COLS)} FROM jobs_c")
def q_slim(spark, sf):
    return CH.slim(jobs(spark, sf))


SIZE = 1000  # several chunks at every scale


@register("chunk_manifest", f"""{W},
r AS (SELECT job_id, row_number() OVER (ORDER BY lower(coalesce(company, '')), lower(coalesce(title, '')), job_id) - 1 AS idx
  FROM jobs_c)
SELECT CAST(idx // {SIZE} AS BIGINT) AS chunk_id, count(*) AS n, CAST(sum(job_id) AS BIGINT) AS id_sum,
 CAST(sum(job_id * (idx % {SIZE} + 1)) AS BIGINT) AS order_sum
FROM r GROUP BY 1""")
def q_chunk_manifest(spark, sf):
    """Publish, then read every chunk file back: what landed where, and in which order inside the file."""
    base, manifest, _ = _published(spark, sf)
    root = f"{base}/{RELEASE}/chunks/"
    files = spark.read.text([root + f for f in manifest["chunks"]], wholetext=True)
    cid = F.regexp_extract(F.input_file_name(), r"chunk_id=(\d+)", 1).cast("bigint")
    rows = files.select(cid.alias("chunk_id"), F.posexplode(F.from_json("value", T.ArrayType(SLIM_SCHEMA))).alias("at", "row"))
    job = F.col("row.job_id")
    return rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum(job).alias("id_sum"), F.sum(job * (F.col("at") + 1)).alias("order_sum"))


@register("src_chunks", f"{W}\nSELECT job_id, {', '.join(SLIM_COLS)} FROM jobs_c")
def q_src_chunks(spark, sf):
    base, _, _ = _published(spark, sf)
    return CH.read_chunks(spark, f"{base}/{RELEASE}", SLIM_SCHEMA).select("job_id", *SLIM_COLS)


_LAST = f"CAST((SELECT (count(*) - 1) // {SIZE} FROM jobs) AS VARCHAR)"


@register("publish_check", f"""{W}
SELECT 'no_manifest' AS release, 'manifest missing' AS problem
UNION ALL SELECT 'no_chunks', 'no chunks listed'
UNION ALL SELECT 'lost_last', 'missing: data/chunk_id=' || {_LAST}
UNION ALL SELECT 'empty_first', 'empty: data/chunk_id=0'
UNION ALL SELECT 'lost_and_empty', 'missing: data/chunk_id=' || {_LAST}
UNION ALL SELECT 'lost_and_empty', 'empty: data/chunk_id=0'""")
def q_publish_check(spark, sf):
    """A valid release has no problems; broken ones, made of its files, have just their own."""
    import json
    base, manifest, problems = _published(spark, sf)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    src = f"{base}/{RELEASE}/chunks"
    fs, _ = CH._fs(spark, src)
    files = manifest["chunks"]
    out = problems.withColumn("release", F.lit("good"))
    faults = {"no_manifest": (set(), set()), "no_chunks": (set(), set()), "lost_last": ({files[-1]}, set()),
              "empty_first": (set(), {files[0]}), "lost_and_empty": ({files[-1]}, {files[0]})}
    for name, (lost, empty) in faults.items():
        target = new_snapshot_dir(spark, name)
        for f in {files[0], files[-1]} - lost:
            if f in empty:
                fs.create(path(f"{target}/chunks/{f}"), True).close()
            else:
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(f"{src}/{f}"), fs, path(f"{target}/chunks/{f}"), False, conf)
        listed = [] if name == "no_chunks" else sorted({files[0], files[-1]})
        if name != "no_manifest":
            CH.write_text(spark, f"{target}/chunks/{CH.MANIFEST}", json.dumps(dict(manifest, chunks=listed)))
        out = out.unionByName(CH.check_snapshot(spark, target).withColumn("release", F.lit(name)))
    return out.select("release", F.regexp_replace("problem", "/part-.*", "").alias("problem"))
