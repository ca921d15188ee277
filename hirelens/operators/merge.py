"""Keyed merge of a new scrape into the standing dataset.

Semantics (per key, after dropping empty keys):
  * retention: an existing row survives unless its scraped_at is a parseable,
    zone-qualified instant whose whole-day age exceeds ``max_days``
    (age < (max_days + 1) days is kept; future and unparseable rows are kept);
  * last-wins: among rows of one side, the row with the largest ``seq`` wins;
  * overlay: a key present in the new scrape takes the new row; its first_seen
    is the prior first_seen when the key already existed (NULL stays NULL),
    otherwise the new row's scraped_at; keys only in the existing data stay;
  * new_count: rows of the new scrape (duplicates included) whose key was not
    in the retained existing data.

Plan: the two sides are unioned and reduced by ONE aggregate on the key (max_by
over a (side, seq) ordering). Whole rows are kept in the buffer, so Spark plans a
sort aggregate: a sort on each side of the single shuffle. The partial one
collapses hot keys map-side, so a key holding a third of all rows costs no more
in the shuffle than any other; there is no join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import presets
from .search import epoch_micros

_DAY_US = 86_400_000_000
# ISO text with an explicit zone: Z or +hh:mm / -hh:mm (or +hhmm) at the end.
_TZ_SUFFIX = r"(?i)(z|[+-]\d{2}:?\d{2})$"


def stale_at(df: DataFrame, ts_col: str, now_us: Column, max_days: int = presets.RETENTION_DAYS) -> Column:
    """``stale_flag`` by a clock in microseconds since 1970 that may differ from row to row; a null clock keeps all."""
    c = F.col(ts_col)
    if isinstance(df.schema[ts_col].dataType, T.StringType):
        s = F.trim(c)
        ts = F.when(s.rlike(_TZ_SUFFIX), s.try_cast("timestamp"))
    else:
        ts = c.cast("timestamp")
    age = now_us - F.unix_micros(ts)
    return F.coalesce(age >= F.lit((max_days + 1) * _DAY_US), F.lit(False))


def stale_flag(df: DataFrame, ts_col: str, now: dt.datetime, max_days: int = presets.RETENTION_DAYS) -> Column:
    """True when the row is too old to keep. String columns: only zone-qualified
    parseable text can be stale (zone-less text cannot be compared, so it is
    kept). Timestamp columns are instants (NTZ read as UTC)."""
    return stale_at(df, ts_col, F.lit(epoch_micros(now)), max_days)


def retain(df: DataFrame, ts_col: str, now: dt.datetime, max_days: int = presets.RETENTION_DAYS) -> DataFrame:
    return df.filter(~stale_flag(df, ts_col, now, max_days))


def stale_count(df: DataFrame, key: str, ts_col: str, now: dt.datetime,
                max_days: int = presets.RETENTION_DAYS) -> DataFrame:
    keyed = df.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return keyed.agg(F.count_if(stale_flag(keyed, ts_col, now, max_days)).alias("stale_count"))


def dedup_last(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """One row per key: the row with the greatest ``seq`` tuple (arrival order).
    A max_by aggregate (sort-based, partial combine): hot keys collapse before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in seq])
    win = F.max_by(F.struct(*[F.col(c) for c in others]), order).alias("_w")
    return df.groupBy(*keys).agg(win).select(*keys, "_w.*")


def overlay(existing: DataFrame, new: DataFrame, key: str = "key", seq: str = "seq",
            scraped: str = "scraped_at", first_seen: str = "first_seen") -> tuple[DataFrame, DataFrame]:
    """Overlay ``new`` onto (already retained) ``existing``.
    Returns (merged rows, DataFrame(new_count)). Both inputs carry ``key`` and
    ``seq``; rows with an empty key are ignored. The result has the columns of
    both sides: a key of the new scrape takes its new row whole (NULL in columns
    that only the existing data has), any other keeps its existing row whole."""
    fs_type = (existing.schema[first_seen].dataType if first_seen in existing.columns
               else new.schema[scraped].dataType)

    def side(df: DataFrame, s: int) -> DataFrame:
        d = df if first_seen in df.columns else df.withColumn(first_seen, F.lit(None).cast(fs_type))
        d = d.filter(F.coalesce(F.col(key), F.lit("")) != "")
        return d.withColumn("_side", F.lit(s))

    u = side(existing, 0).unionByName(side(new, 1), allowMissingColumns=True)
    order = [*new.columns, *[c for c in u.columns if c not in new.columns]]
    cols = [c for c in order if c not in (key, "_side")]
    is_ex = F.col("_side") == 0
    g = u.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col("_side"), F.col(seq))).alias("_w"),
        F.max_by(F.col(first_seen), F.struct(is_ex, F.col(seq))).alias("_ex_fs"),
        F.max(is_ex.cast("int")).alias("_has_ex"),
        F.count_if(~is_ex).alias("_n_new"),
    )
    fs = (F.when(F.col("_n_new") == 0, F.col(f"_w.{first_seen}"))
          .when(F.col("_has_ex") == 1, F.col("_ex_fs"))
          .otherwise(F.col(f"_w.{scraped}")))
    merged = g.select(F.col(key), *[(fs if c == first_seen else F.col(f"_w.{c}")).alias(c) for c in cols])
    new_count = (g.filter(F.col("_has_ex") == 0)
                 .agg(F.coalesce(F.sum("_n_new"), F.lit(0)).cast("bigint").alias("new_count")))
    return merged, new_count


def merge_metadata(merged: DataFrame, new_count: DataFrame, now: dt.datetime) -> DataFrame:
    """One row about a merged dataset: total_jobs, new_jobs, last_updated."""
    return merged.agg(F.count(F.lit(1)).alias("total_jobs")).crossJoin(new_count.select(F.col("new_count").alias("new_jobs"))) \
        .withColumn("last_updated", F.lit(now.strftime("%Y-%m-%dT%H:%M:%SZ")))


def merge(existing: DataFrame, new: DataFrame, now: dt.datetime, key: str = "key", seq: str = "seq",
          scraped: str = "scraped_at", max_days: int = presets.RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """Retention, then overlay (a pruned key scraped again is new again)."""
    kept = retain(existing, scraped, now, max_days)
    return overlay(kept, new, key, seq, scraped)


def count_new(existing: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``new`` (duplicates included) whose key is absent from ``existing``."""
    ex = existing.select(key).filter(F.coalesce(F.col(key), F.lit("")) != "")
    nw = new.filter(F.coalesce(F.col(key), F.lit("")) != "")
    return nw.join(ex, key, "left_anti").agg(F.count(F.lit(1)).alias("new_count"))


def upsert_status(status: DataFrame, changes: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """Status table upsert: a change replaces the stored status for its URL; of
    several changes the one with the greatest ``seq`` wins."""
    s = status.withColumn("_o", F.struct(F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("seq")))
    c = changes.withColumn("_o", F.struct(F.lit(1).alias("side"), F.col(seq).cast("bigint").alias("seq")))
    cols = [x for x in status.columns if x != key]
    u = s.select(key, *cols, "_o").unionByName(c.select(key, *cols, "_o"))
    return (u.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("_o")).alias("_w"))
            .select(key, "_w.*"))


def delete_status(status: DataFrame, urls: DataFrame, key: str = "url") -> DataFrame:
    return status.join(urls.select(key), key, "left_anti")
