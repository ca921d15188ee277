"""Salary shards: JSON objects ``{"company|title|level": {p25, median, p75, n}}``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALARY_VALUE = "struct<p25: int, median: int, p75: int, n: int>"


def read_salary(spark: SparkSession, path: str) -> DataFrame:
    """All shard files under ``path`` -> (key, company, title, level, p25,
    median, p75, n). Each file is one JSON object keyed by lookup key; parsed
    as a map so keys never become schema fields."""
    files = spark.read.format("text").option("wholetext", "true").load(path)
    # a file holds one object (possibly pretty-printed) or several, one per
    # line: top-level objects are the only lines starting with '{'
    docs = files.select(F.explode(F.split("value", r"\n(?=\{)")).alias("doc"))
    m = docs.select(F.explode(F.from_json("doc", f"map<string, {SALARY_VALUE}>")).alias("key", "v"))
    parts = F.split("key", r"\|")
    return m.select("key", F.when(F.size(parts) == 3, parts[0]).alias("company"),
                    F.element_at(parts, -2).alias("title"), F.element_at(parts, -1).alias("level"), "v.*")


def read_salary_lookup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One file ``{"primary": {key: values}, "fallback": {key: values}}`` -> two lookup tables
    (key, p25, median, p75, n); a missing file gives two empty ones."""
    entries = f"map<string, {SALARY_VALUE}>"
    try:
        files = spark.read.format("text").option("wholetext", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], "key string, p25 int, median int, p75 int, n int")
        return empty, empty
    b = files.select(F.from_json("value", f"primary {entries}, fallback {entries}").alias("b"))
    return tuple(b.select(F.explode(f"b.{part}").alias("key", "v")).select("key", "v.*") for part in ("primary", "fallback"))


def write_salary(table: DataFrame, path: str, keys_per_object: int = 50_000) -> str:
    """Write (key, p25, median, p75, n) as shard folders ``shard=<letter>`` of
    JSON objects. Keys are hash-bucketed so each object holds about
    ``keys_per_object`` keys whatever the table size (one count sizes it)."""
    letter = F.when(F.substring("key", 1, 1).rlike("^[a-z]$"), F.substring("key", 1, 1)).otherwise(F.lit("_"))
    buckets = max(1, -(-table.count() // keys_per_object))
    b = F.pmod(F.xxhash64("key"), F.lit(buckets))
    obj = (table.groupBy(letter.alias("shard"), b.alias("bucket"))
           .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", F.struct("p25", "median", "p75", "n")))))
                .alias("value")))
    obj.select("shard", "value").write.mode("errorifexists").partitionBy("shard").text(path)
    return path
