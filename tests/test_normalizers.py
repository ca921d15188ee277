"""Platform normalisers on hand-made raw responses (edge cases)."""

import datetime as dt
import json

from hirelens.sources import raw as R

SCHEMA = "platform string, slug string, status int, content_type string, page int, body string, fetched_at timestamp_ntz"
NOW = dt.datetime(2025, 3, 10)


def _raw(spark, rows):
    return spark.createDataFrame([r + (NOW,) for r in rows], SCHEMA)


def _wd(total, titles):
    return json.dumps({"total": total, "jobPostings": [{"title": t, "externalPath": f"/jobs/{i}/x",
                                                         "locationsText": "", "postedOn": "Posted 3 Days Ago"}
                                                        for i, t in enumerate(titles)]})


def test_workday_pager_stops_at_changed_total_empty_or_failed_page(spark):
    rows = [("Workday", "a|wd1|s", 200, "application/json", 0, _wd(3, ["A0", "A1"])),
            ("Workday", "a|wd1|s", 200, "application/json", 1, _wd(4, ["A2"])),       # total changed: stop
            ("Workday", "b|wd2|s", 200, "application/json", 0, _wd(3, ["B0"])),
            ("Workday", "b|wd2|s", 200, "application/json", 1, _wd(3, [])),           # empty: stop
            ("Workday", "b|wd2|s", 200, "application/json", 2, _wd(3, ["B2"])),
            ("Workday", "c|wd1|s", 200, "application/json", 0, _wd(2, ["C0"])),
            ("Workday", "c|wd1|s", 500, "application/json", 1, ""),                    # failed: stop
            ("Workday", "bad-slug", 200, "application/json", 0, _wd(1, ["X"]))]        # not company|wdN|site
    out = R.normalize_workday(_raw(spark, rows)).collect()
    assert sorted(r["title"] for r in out) == ["A0", "A1", "B0", "C0"]
    a0 = [r for r in out if r["title"] == "A0"][0]
    assert a0["company"] == "a" and a0["url"] == "https://a.wd1.myworkdayjobs.com/s/jobs/0/x"
    assert a0["location"] == "Not specified" and a0["updated_at"] == "2025-03-07"


def test_paylocity_missing_or_invalid_blob_gives_no_jobs(spark):
    blob = {"Jobs": [{"JobId": 7, "JobTitle": "R&amp;D Engineer", "LocationName": "Main",
                      "JobLocation": {"City": "Austin", "State": None}, "IsRemote": None, "HiringDepartment": "Ops"},
                     {"JobId": None, "JobTitle": "Clerk", "LocationName": None, "JobLocation": None}]}
    rows = [("Paylocity", "g1", 200, "text/html", 0,
             f"<html><script>window.pageData = {json.dumps(blob)};\n</script></html>"),
            ("Paylocity", "g2", 200, "text/html", 0, "<html>no blob here</html>"),
            ("Paylocity", "g3", 200, "text/html", 0, "<script>window.pageData = {oops};</script>")]
    names = spark.createDataFrame([("g1", "Acme &amp; Sons")], "slug string, name string")
    out = sorted(R.normalize_paylocity(_raw(spark, rows), names).collect(), key=lambda r: r["title"])
    assert [r["title"] for r in out] == ["Clerk", "R&D Engineer"]
    clerk, eng = out
    assert eng["company"] == "Acme & Sons" and eng["location"] == "Austin" and eng["id"] == "7"
    assert eng["url"].endswith("/Jobs/Details/7") and list(eng["departments"]) == ["Ops"]
    assert clerk["location"] == "Not specified" and clerk["url"].endswith("/jobs/All/g1/")
    statuses = {r["slug"]: r["status"] for r in R.effective_status(_raw(spark, rows)).collect()}
    assert statuses == {"g1": 200, "g2": 200, "g3": 200}


def test_bamboohr_non_json_counts_as_404(spark):
    body = json.dumps({"result": [{"id": "5", "jobOpeningName": "Nurse", "location": {"city": "Omaha", "state": ""}}]})
    rows = [("BambooHR", "ok", 200, "application/json; charset=utf-8", 0, body),
            ("BambooHR", "html", 200, "text/html", 0, "<html/>")]
    raw = _raw(spark, rows)
    out = R.normalize_bamboohr(raw).collect()
    assert [(r["slug"], r["location"], r["url"]) for r in out] == [("ok", "Omaha", "https://ok.bamboohr.com/careers/5")]
    assert {r["slug"]: r["status"] for r in R.effective_status(raw).collect()} == {"ok": 200, "html": 404}


def test_icims_sitemap_filters_and_titles(spark):
    body = ('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
            "<url><loc>https://careers-z.icims.com/jobs/intro</loc></url>"
            "<url><loc> https://careers-z.icims.com/jobs/12/senior-data-engineer/job </loc><lastmod>2025-01-02</lastmod></url>"
            "<url><loc>https://careers-z.icims.com/about</loc></url></urlset>")
    out = R.normalize_icims(_raw(spark, [("iCIMS", "z", 200, "text/xml", 0, body)])).collect()
    assert [(r["title"], r["updated_at"], r["skill_level"]) for r in out] == [("Senior Data Engineer", "2025-01-02", "senior")]


def test_bamboohr_locations_of_both_shapes(spark):
    import json

    from hirelens.sources import raw as R
    jobs = [{"id": "1", "jobOpeningName": "A", "location": {"city": "Ulm", "state": ""}}, {"id": "2", "jobOpeningName": "B", "location": "Plain place " + "x" * 60},
            {"id": "3", "jobOpeningName": "C", "location": None}, {"id": "4", "jobOpeningName": "D", "location": ""}, {"id": "5", "jobOpeningName": "E"}]
    raw = spark.createDataFrame([("BambooHR", "s", 200, "application/json", 0, json.dumps({"result": jobs}))],
                                "platform string, slug string, status int, content_type string, page int, body string")
    got = {r.title: (r.location, r.location_full, r.lookup) for r in R.normalize_bamboohr(raw).collect()}
    whole = "Plain place " + "x" * 60
    assert got["A"] == ("Ulm",) * 3 and got["B"] == (whole[:50], whole, whole)
    assert got["C"] == got["D"] == got["E"] == ("Not specified",) * 3
