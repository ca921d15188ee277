"""Trend log as JSON Lines: write a new snapshot folder, read tolerant of torn
lines with last-row-per-date-wins by position in the file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

TREND_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("total_jobs", T.LongType()),
    T.StructField("active_companies", T.LongType()),
    T.StructField("recruiter_jobs", T.LongType()),
    T.StructField("by_platform", T.MapType(T.StringType(), T.LongType())),
    T.StructField("by_tier", T.MapType(T.StringType(), T.LongType())),
])


def new_snapshot_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never overwrite in place)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_trends(log: DataFrame, path: str) -> str:
    """One JSON object per line, sorted by date (the log is one row per day)."""
    out = log.withColumn("date", F.date_format("date", "yyyy-MM-dd")).orderBy("date")
    out.coalesce(1).write.mode("errorifexists").json(path)
    return path


def read_trends(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Read a JSONL trend log. Blank lines are skipped; malformed lines are
    skipped too (status page, snapshot writer) or, with ``strict=True``, fail
    the read (anomaly check). When a date repeats, the row appearing last
    (file, then line position) wins."""
    files = spark.read.format("text").option("wholetext", "true").load(path) \
        .withColumn("_file", F.input_file_name())
    lines = files.select("_file", F.posexplode(F.split("value", "\n")).alias("_pos", "_line"))
    parsed = (lines.filter(F.trim("_line") != "")
              .withColumn("_row", F.from_json(F.trim("_line"), TREND_SCHEMA,
                                              {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
              .filter(F.col("_row.date").isNotNull()))
    w = Window.partitionBy("_row.date").orderBy(F.col("_file").desc(), F.col("_pos").desc())
    last = parsed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return last.select("_row.*").withColumn("date", F.to_date("date")).orderBy("date")
