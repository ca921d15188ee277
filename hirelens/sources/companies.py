"""Tracked-company lists: flat JSON string arrays, or Paylocity object arrays
``[{guid, name, jobs}]``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, html_unescape


def read_companies(spark: SparkSession, path: str, kind: str = "flat") -> DataFrame:
    """-> (slug, name) distinct. ``flat``: every string is a slug, name NULL.
    ``paylocity``: rows without a guid are dropped, the name falls back to the
    guid and is HTML-unescaped. A missing path yields an empty table."""
    schema = "slug string, name string"
    try:
        files = spark.read.format("text").option("wholetext", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    # a file holds one array (possibly pretty-printed) or several, one a line
    files = files.select(F.explode(F.split("value", r"\n(?=\[)")).alias("value"))
    if kind == "flat":
        rows = files.select(F.explode(F.from_json("value", "array<string>")).alias("slug"))
        return rows.filter(blank_to_null(F.col("slug")).isNotNull()) \
            .select("slug", F.lit(None).cast("string").alias("name")).distinct()
    rows = files.select(F.explode(F.from_json("value", "array<struct<guid: string, name: string, jobs: bigint>>"))
                        .alias("r"))
    rows = rows.filter(blank_to_null(F.col("r.guid")).isNotNull())
    return (rows.select(F.col("r.guid").alias("slug"), F.coalesce(blank_to_null(F.col("r.name")), F.col("r.guid"))
                        .alias("_n"))
            .groupBy("slug").agg(F.max("_n").alias("_n"))
            .select("slug", html_unescape(F.col("_n")).alias("name")))


def write_companies(companies: DataFrame, path: str, kind: str = "flat", chunk_rows: int = 25_000,
                    order: str = "c_custkey") -> str:
    """Write (slug[, name]) as JSON array files, one per key range of ``order``
    (at most ``chunk_rows`` keys per file, so no group is unbounded)."""
    chunk = F.floor(F.col(order) / chunk_rows)
    item = F.col("slug") if kind == "flat" else F.struct(F.col("slug").alias("guid"), "name")
    out = companies.groupBy(chunk.alias("chunk")).agg(F.to_json(F.collect_list(item)).alias("value"))
    out.select("value").write.mode("errorifexists").text(path)
    return path
