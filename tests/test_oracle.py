"""Registered queries vs their DuckDB oracle SQL on the smallest tables.

A representative subset runs by default; HIRELENS_ORACLE_ALL=1 runs every
registered query (the driver checks all of them at sf0.01)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from hirelens.plans import registry
from tools.check_oracle import TABLES, digest

registry.load_all()
SF = "/root/testdata/sf0.001"
SUBSET = ["new_matching", "search", "flt_location_fuzzy", "page_past_end", "clean_reasons", "facet_country",
          "heatmap_jitter", "marker_sample", "merge_first_seen", "new_job_count", "dedup_last", "status_upsert",
          "anomaly_zscore", "trend_history", "norm_workday", "norm_icims", "norm_paylocity", "fetch_stats",
          "salary_enrich", "geo_resolve", "country_backfill_report", "url_title", "chunk_manifest",
          "stream_daily_counts"]
NAMES = sorted(registry.ORACLE) if os.environ.get("HIRELENS_ORACLE_ALL") else SUBSET
FAMILY = {"LongType": "int64", "IntegerType": "int32", "DoubleType": "float", "StringType": "str",
          "BooleanType": "bool", "TimestampNTZType": "ts", "DateType": "date",
          "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool",
          "TIMESTAMP": "ts", "DATE": "date"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    spark_types = {f.name: FAMILY[type(f.dataType).__name__] for f in df.schema.fields}
    duck_types = {c: FAMILY.get(str(t).split("(")[0], str(t))
                  for c, t in zip(ocols, con.sql(E.oracle_sql()[name]).types)}
    assert spark_types == duck_types
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns and df.count() >= 0
