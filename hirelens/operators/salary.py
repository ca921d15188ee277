"""Salary estimate lookup: company|title|level, else title|level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets
from ..functions.text import strip_ws


def lookup_part(c) -> Column:
    return F.lower(strip_ws(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def enrich_salary(jobs: DataFrame, primary: DataFrame, fallback: DataFrame | None = None,
                  default_level: str = presets.SALARY_DEFAULT_LEVEL) -> DataFrame:
    """Add ``salary`` = primary[company|title|level] or fallback[title|level].
    Lookup tables: (key, p25, median, p75, n). Equi left joins; Spark's size
    check broadcasts a small table and shuffles a large one."""
    level = F.coalesce(F.col("skill_level"), F.lit(default_level))
    j = jobs.withColumn("_pk", F.concat_ws("|", lookup_part("company"), lookup_part("title"), level)) \
        .withColumn("_fk", F.concat_ws("|", lookup_part("title"), level))
    val = F.struct("p25", "median", "p75", "n")
    p = primary.select(F.col("key").alias("_pk"), val.alias("_ps"))
    j = j.join(p, "_pk", "left")
    if fallback is not None:
        f = fallback.select(F.col("key").alias("_fk"), val.alias("_fs"))
        j = j.join(f, "_fk", "left")
        sal = F.coalesce("_ps", "_fs")
        src = F.when(F.col("_ps").isNotNull(), "primary").when(F.col("_fs").isNotNull(), "fallback")
        return j.withColumn("salary", sal).withColumn("salary_source", src).drop("_pk", "_fk", "_ps", "_fs")
    return (j.withColumn("salary", F.col("_ps")).withColumn("salary_source", F.when(F.col("_ps").isNotNull(), "primary"))
            .drop("_pk", "_fk", "_ps"))
