"""Search controls, fuzzy location matching, sorting and paging."""

import datetime as dt

from pyspark.sql import functions as F

from hirelens.functions.text import fuzzy_match, word_match
from hirelens.operators import search as S

NOW = dt.datetime(2025, 1, 10)


def _jobs(spark):
    rows = [(1, "Software Engineer", "acme", "acme", "Austin, TX", "US", False, 120000, "2025-01-09T12:00:00Z"),
            (2, "Sales Director", "Acme Staffing", "acme staffing", "Remote - US", "US", True, None, None),
            (3, "C++ Developer", "globex", "globex", "Londn", None, False, 90000, "2024-12-01T00:00:00Z"),
            (4, "Cloud Engineer", "initech", "initech", "Toronto", "CA", False, None, "bad date")]
    return S.classify_jobs(spark.createDataFrame(
        rows, "job_id long, title string, company string, company_slug string, location string, country string, "
              "remote boolean, salary_median int, first_seen string").withColumn("updated_at", F.lit(None).cast("string"))
        .withColumn("url", F.concat(F.lit("u"), F.col("job_id").cast("string"))))


def ids(df):
    return sorted(r["job_id"] for r in df.select("job_id").collect())


def test_default_hides_recruiters(spark):
    assert ids(S.search(_jobs(spark), S.FilterSpec(), NOW)) == [1, 3, 4]


def test_fuzzy_threshold(spark):
    df = spark.createDataFrame([("london",), ("lond",), ("paris",)], "loc string")
    # 'londn' vs 'london': 1 - 1/6 > .75; vs 'lond': 1 - 1/5 = .8; 'paris' far
    assert [r[0] for r in df.select(fuzzy_match("loc", "londn")).collect()] == [True, True, False]
    exact = spark.createDataFrame([("abcd",)], "w string")
    assert exact.select(fuzzy_match("w", "abce")).collect()[0][0] is True      # exactly 0.75


def test_word_match_escapes_term(spark):
    df = spark.createDataFrame([("c++ developer",), ("c developer",)], "t string")
    assert [r[0] for r in df.select(word_match("t", "C++")).collect()] == [False, False]
    assert [r[0] for r in df.select(word_match("t", "developer")).collect()] == [True, True]


def test_salary_bounds_drop_nulls(spark):
    assert ids(S.search(_jobs(spark), S.FilterSpec(hide_recruiters=False, salary_min=100000), NOW)) == [1]
    assert ids(S.search(_jobs(spark), S.FilterSpec(hide_recruiters=False, has_salary=True), NOW)) == [1, 3]


def test_country_modes(spark):
    j = _jobs(spark)
    assert ids(S.search(j, S.FilterSpec(hide_recruiters=False, country="US"), NOW)) == [1, 2]
    assert ids(S.search(j, S.FilterSpec(hide_recruiters=False, country="US", include_unknown_country=True), NOW)) == [1, 2, 3]
    assert ids(S.search(j, S.FilterSpec(hide_recruiters=False, country=S.UNKNOWN), NOW)) == [3]
    assert ids(S.search(j, S.FilterSpec(hide_recruiters=False, country=S.REMOTE), NOW)) == [2]


def test_fresh_and_posted(spark):
    j = _jobs(spark)
    assert ids(S.search(j, S.FilterSpec(hide_recruiters=False, fresh_hours=24), NOW)) == [1]
    assert ids(S.search(j, S.FilterSpec(hide_recruiters=False, posted_days=60), NOW)) == [1, 3]


def test_sort_nulls_last_both_ways(spark):
    j = _jobs(spark)
    asc = [r["job_id"] for r in S.sort_jobs(j, "salary", "asc").collect()]
    desc = [r["job_id"] for r in S.sort_jobs(j, "salary", "desc").collect()]
    assert asc == [3, 1, 2, 4] and desc == [1, 3, 2, 4]


def test_page_past_end_clamps(spark):
    j = _jobs(spark)
    assert S.clamp_page(4, 99, 25) == 1 and S.clamp_page(0, 3, 25) == 1 and S.clamp_page(101, 9, 25) == 5
    assert ids(S.page(j, "company", "asc", 7, 25)) == [1, 2, 3, 4]


def test_presets(spark):
    spec, sort = S.preset("has-salary")
    assert spec.has_salary and sort == ("salary", "desc") and spec.hide_recruiters
    spec, _ = S.preset("new-for-me", _jobs(spark))
    assert spec.country == "US" and spec.fresh_hours == 24 and spec.hide_applied


def test_any_slice_of_the_order(spark, monkeypatch):
    """From the front, from the end and by numbering: the same rows."""
    import random

    from hirelens.operators import search as S
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "b", "a", " C ", f"x{i % 17}"])) for i in range(230)]
    df = spark.createDataFrame(rows, "job_id long, title string")
    for direction in ("asc", "desc"):
        whole = [r.job_id for r in S.sort_jobs(df, "title", direction).collect()]
        for deep in (10, 10**6):
            monkeypatch.setattr(S, "DEEP_ROWS", deep)
            for start, n in ((0, 25), (5, 1), (100, 25), (205, 25), (225, 25), (230, 25)):
                got = [r.job_id for r in S.sorted_rows(df, "title", direction, start, n, len(rows)).collect()]
                assert got == whole[start:start + n]


def test_preset_page_keeps_its_order(spark):
    import datetime as dt

    from hirelens.operators import search as S
    rows = [(i, "c", "c", "Cloud Engineer", "mid", "Lever", None, False, i * 7 % 50 or None, False) for i in range(40)]
    df = spark.createDataFrame([(*r, f"u{r[0]}", "x", dt.datetime(2030, 1, 1)) for r in rows],
                               "job_id long, company string, company_slug string, title string, skill_level string, ats string, country string, "
                               "remote boolean, salary_median int, is_recruiter boolean, url string, location string, first_seen timestamp_ntz")
    got = [r.salary_median for r in S.preset_page("has-salary", df, dt.datetime(2030, 1, 2), per_page=25).collect()]
    assert got == sorted((r[8] for r in rows if r[8]), reverse=True)[:25]
