"""Small files that carry state from run to run: role preset, dead-slug lists, shortlist."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import presets
from .chunks import read_text

SHORTLIST_SCHEMA = ("generated_at STRING, preset STRING, levels ARRAY<STRING>, matched_jobs BIGINT, source STRING, "
                    "platforms MAP<STRING, ARRAY<STRING>>")


def load_role_preset(spark: SparkSession, path: str) -> dict:
    """A role preset file: {name, levels, include, exclude, preferred_country}, the
    shape that ``role_match`` and the presets take. ``include`` is required."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    preset = json.loads(text)
    if not preset.get("include"):
        raise ValueError(f"{path}: a role preset needs include patterns")
    return {"name": preset.get("name", ""), "levels": preset.get("levels") or [], "include": preset["include"],
            "exclude": preset.get("exclude") or [], "preferred_country": preset.get("preferred_country") or ""}


def write_dead(dead: DataFrame, path: str, slugs_per_file: int = 25_000) -> str:
    """(platform, slug) -> a folder per platform of files that each hold one sorted JSON
    array; a platform's slugs are dealt to files by hash, so no array is unbounded."""
    files = max(1, -(-dead.count() // slugs_per_file))
    part = F.pmod(F.xxhash64("slug"), F.lit(files))
    rows = dead.groupBy(F.lower("platform").alias("platform"), part.alias("part")).agg(
        F.to_json(F.array_sort(F.collect_set("slug"))).alias("value"))
    rows.select("platform", "value").write.mode("errorifexists").partitionBy("platform").text(path)
    return path


def read_dead(spark: SparkSession, path: str) -> DataFrame:
    """-> (platform, slug) distinct. A missing folder, and a file that cannot be read as
    an array, hold no dead slugs."""
    names = F.create_map(*[F.lit(x) for p in presets.PLATFORMS for x in (p.lower(), p)])
    try:
        files = spark.read.format("text").option("wholetext", "true").option("basePath", path).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "platform string, slug string")
    if "platform" not in files.columns:
        return spark.createDataFrame([], "platform string, slug string")
    # a file holds one array (possibly pretty-printed) or several, one a line
    arrays = files.select(F.col("platform").cast("string").alias("p"), F.explode(F.split("value", r"\n(?=\[)")).alias("value"))
    rows = arrays.select("p", F.explode(F.from_json("value", "array<string>")).alias("slug"))
    return rows.select(F.coalesce(F.try_element_at(names, F.col("p")), F.col("p")).alias("platform"), "slug").where("slug IS NOT NULL").distinct()


def write_shortlist(shortlist: DataFrame, stats: DataFrame, path: str, now: dt.datetime, preset: dict | None = None,
                    source: str = "full_scrape") -> str:
    """The shortlist file: slugs sorted within platforms, with the postings that matched."""
    preset = preset or presets.ROLE_PRESET
    lists = shortlist.groupBy("platform").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))
    whole = lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "slugs")))).alias("platforms"))
    matched = stats.agg(F.coalesce(F.sum("matched_jobs"), F.lit(0)).cast("bigint").alias("matched_jobs"))
    row = whole.join(matched, F.lit(True)).select(F.to_json(F.struct(
        F.lit(now.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("generated_at"), F.lit(preset.get("name", "")).alias("preset"),
        F.array(*[F.lit(x) for x in sorted(preset.get("levels") or [])]).alias("levels"), "matched_jobs", F.lit(source).alias("source"),
        "platforms")).alias("value"))
    row.coalesce(1).write.mode("errorifexists").text(path)
    return path


def read_shortlist(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame] | None:
    """-> (platform, slug) rows and the one row about them, or None: a full run
    (no shortlist asked for, or the file is missing)."""
    if not path:
        return None
    try:
        text = spark.read.format("text").option("wholetext", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = text.select(F.from_json("value", SHORTLIST_SCHEMA).alias("r")).select("r.*")
    slugs = row.select(F.explode("platforms").alias("platform", "slugs")).select("platform", F.explode("slugs").alias("slug"))
    return slugs, row.drop("platforms")
