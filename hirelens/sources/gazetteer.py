"""Gazetteer files: JSON objects ``{"schema": [names], "data": [[values], ...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["city", "admin", "country", "lat", "lng"]


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """-> (city, admin, country, lat, lng, pos), columns found by their names in each
    file's schema. ``pos`` orders rows as they stand: by file name, then inside the file."""
    files = spark.read.format("text").option("wholetext", "true").load(path)
    b = F.from_json("value", "schema ARRAY<STRING>, data ARRAY<ARRAY<STRING>>")
    rows = files.select(F.input_file_name().alias("file"), b.alias("b")).select(
        "file", F.col("b.schema").alias("schema"), F.posexplode("b.data").alias("i", "row"))

    def field(name: str) -> Column:
        return F.get("row", F.array_position("schema", name).cast("int") - 1)

    return rows.select(*[field(n).alias(n) for n in FIELDS[:3]], *[field(n).cast("double").alias(n) for n in FIELDS[3:]],
                       F.struct("file", "i").alias("pos"))


def write_gazetteer(gaz: DataFrame, path: str, rows_per_file: int = 5000) -> str:
    """Write (city, admin, country, lat, lng, pos) in order of ``pos`` (0, 1, ...), so many rows a file."""
    part = F.lpad(F.floor(F.col("pos") / rows_per_file).cast("string"), 12, "0")
    data = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array(*[F.col(n).cast("string") for n in FIELDS]).alias("row")))), lambda x: x["row"])
    out = gaz.groupBy(part.alias("part")).agg(data.alias("data")).select(
        "part", F.to_json(F.struct(F.array(*[F.lit(n) for n in FIELDS]).alias("schema"), "data")).alias("value"))
    out.write.partitionBy("part").text(path)
    return path
