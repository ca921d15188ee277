"""Partial aggregates: a changed part alone is written anew, totals are exact, sketches close, old folders gone."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from hirelens.operators import facets as FA
from hirelens.operators import partials as PA
from hirelens.streaming import streams as ST

NOW = dt.datetime(2030, 1, 2, 12, 0, 30)  # divides a minute
COLS = "id long, ats string, skill_level string, country string, remote boolean, company string, company_slug string, first_seen timestamp_ntz"


def postings(spark, n=6000):
    return spark.range(n).selectExpr("id", "element_at(array('Lever', 'Ashby', '', null), int(id % 4) + 1) AS ats", "if(id % 3 = 0, 'Senior', 'Mid') AS skill_level",
                                     "element_at(array('US', '', null), int(id % 3) + 1) AS country", "if(id % 5 = 0, true, if(id % 7 = 0, null, false)) AS remote",
                                     "concat('c', id % 2500) AS company", "if(id % 11 = 0, 'agency', '') AS company_slug",
                                     "if(id % 13 = 0, null, timestamp_ntz'2030-01-01 00:00:00' + make_dt_interval(0, 0, 0, (id * 37) % 180000)) AS first_seen")


def check(spark, rows, root):
    parts = PA.read(spark, root)
    key = lambda r: (r.value, r.n)
    own = PA.counts(parts, ("ats", "skill_level", "country")).collect()
    assert sorted(key(r) for r in own if r.facet != "country") == sorted(key(r) for r in FA.facet_counts(rows).collect())
    assert sorted(key(r) for r in own if r.facet == "country") == sorted(key(r) for r in FA.facet_country(rows).collect())
    want = FA.stats(rows, NOW, matching=F.col("id") % 2 == 0).first()
    got = PA.totals(parts, NOW, rows).first()
    assert (got.total_jobs, got.matching, got.fresh) == (want.total_jobs, want.matching, want.fresh_24h)
    assert abs(PA.companies(parts).first().companies - want.companies) <= 0.05 * want.companies


def test_parts_change_alone(spark, tmp_path):
    root, rows = f"{tmp_path}/p", postings(spark)
    part = F.floor(F.col("id") / 1000)
    make = lambda df: PA.partial(df, part, matching=F.col("id") % 2 == 0)
    assert PA.put(spark, root, make(rows.filter("id < 5000"))) == ["0", "1", "2", "3", "4"]
    before = PA.live(spark, root)
    PA.put(spark, root, make(rows.filter("id >= 5000")))
    check(spark, rows, root)
    # one part changes: the others stay the files they were
    changed = rows.filter("NOT (id BETWEEN 2000 AND 2999 AND id % 2 = 0)")
    PA.put(spark, root, make(changed.filter("id BETWEEN 2000 AND 2999")))
    after = PA.live(spark, root)
    assert {p for p in before if before[p] != after[p]} == {"2"} and not os.path.exists(f"{root}/{before['2']}")
    check(spark, changed, root)
    PA.drop(spark, root, ["5"])
    check(spark, changed.filter("id < 5000"), root)
    PA.compact(spark, root, ["0", "1"], "0-1")
    assert set(PA.live(spark, root)) == {"0-1", "2", "3", "4"}
    check(spark, changed.filter("id < 5000"), root)
    with pytest.raises(ValueError):
        PA.totals(PA.read(spark, root), NOW)


def test_nothing_stored(spark, tmp_path):
    empty = PA.read(spark, str(tmp_path))
    got = PA.totals(empty, dt.datetime(2030, 1, 1)).first()
    assert (got.total_jobs, got.matching, got.fresh) == (0, 0, 0) and PA.counts(empty, ("ats",)).count() == 0


def test_stream_folds_and_replays(spark, tmp_path):
    rows = postings(spark, 700).select("id", "ats", "skill_level", "company")
    for k in range(4):
        rows.filter(f"id % 4 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        ST.start_partial_stream(src, f"{tmp_path}/p", f"{tmp_path}/ckpt", fold=2).awaitTermination()
    parts = PA.live(spark, f"{tmp_path}/p")
    assert len(parts) == 2 and max(parts) == "e000000000003"
    key = lambda df: sorted((r.facet, r.value, r.n) for r in df.collect())
    want = key(FA.facet_counts(rows))
    assert key(PA.counts(PA.read(spark, f"{tmp_path}/p"), ("ats", "skill_level"))) == want
    # the newest epoch comes again: nothing is counted twice
    PA.put(spark, f"{tmp_path}/p", PA.partial(rows.filter("id % 4 = 3"), F.lit("e000000000003")))
    assert key(PA.counts(PA.read(spark, f"{tmp_path}/p"), ("ats", "skill_level"))) == want
    assert {f.split("/")[0] for f in PA.live(spark, f"{tmp_path}/p").values()} <= {d for d in os.listdir(f"{tmp_path}/p") if d.startswith("w=")}
