"""The order index: exact numbers, pages that read few folders, no partition in the plan; first pages in one pass."""

import contextlib
import io

from pyspark.sql import functions as F

from hirelens.operators import order_index
from hirelens.operators import search as S


def test_numbers_and_seeks(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5003 AS k", "id % 3 AS other")
    index = order_index.build(df, [F.col("k")], 40)
    want = sorted(r.k for r in df.collect())
    assert index.total == 5000 and set(index.rows.columns) == {"k", "other", "_part", "_place"}
    assert [r.k for r in index.numbered().orderBy("_idx").collect()] == want
    for start, n in ((0, 10), (2345, 60), (4990, 60), (5000, 5), (17, 0)):
        assert [r.k for r in index.seek(start, n).orderBy("_idx").collect()] == want[start:start + n]
    met = index.fences.filter((F.col("first") < 2405) & (F.col("first") + F.col("n") > 2345)).count()
    assert met <= 3 < index.fences.count()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        index.seek(2345, 60).explain("formatted")
    assert "dynamicpruning" in text.getvalue() and len(text.getvalue()) < 10_000


def test_nothing_to_number(spark):
    index = order_index.build(spark.range(0).toDF("k"), [F.col("k")], 4)
    assert index.total == 0 and index.numbered().count() == 0 and index.seek(0, 5).count() == 0


def test_deep_page_is_the_sorted_slice(spark, monkeypatch):
    monkeypatch.setattr(S, "DEEP_ROWS", 50)
    df = spark.range(1000).selectExpr("id AS job_id", "int((id * 37) % 101) AS salary_median", "'t' AS title", "'c' AS company", "timestamp_ntz'2030-01-01' AS first_seen")
    whole = [r.job_id for r in S.sort_jobs(df, "salary", "desc").collect()]
    assert [r.job_id for r in S.page(df, "salary", "desc", 20, 25).collect()] == whole[475:500]
    assert [r.job_id for r in S.page(df, "salary", "desc", 99, 25).collect()] == whole[975:]


def test_first_page_runs_no_count(spark):
    df = spark.range(500).selectExpr("id AS job_id", "int(id % 7) AS salary_median", "'t' AS title", "'c' AS company", "timestamp_ntz'2030-01-01' AS first_seen")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("first-page", "")
    try:
        page = S.page(df, "salary", "desc", 1, 25)
        assert len(tracker.getJobIdsForGroup("first-page")) == 0  # planning the page ran nothing
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert page.count() == 25
