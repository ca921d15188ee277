"""Clean step: drop rows without a usable title, URL or company, and count the
first failing reason per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import clean_reason


def clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return (kept rows, DataFrame(reason, n)). Both are lazy; the counts are a
    map-side-combined aggregate over three keys, never a driver loop."""
    cols = set(df.columns)
    reason = clean_reason(
        "title", "url",
        "absolute_url" if "absolute_url" in cols else F.lit(None).cast("string"),
        "company",
        "company_slug" if "company_slug" in cols else F.lit(None).cast("string"),
    )
    tagged = df.withColumn("_reason", reason)
    kept = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    counts = (tagged.filter(F.col("_reason").isNotNull())
              .groupBy(F.col("_reason").alias("reason"))
              .agg(F.count(F.lit(1)).alias("n")))
    return kept, counts
