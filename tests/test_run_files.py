"""Files that carry state between runs: presets, dead slugs, shortlists, salary lookups, gazetteers."""

import datetime as dt
import json

import pytest

from hirelens.functions.classify import role_match
from hirelens.operators import geo as G
from hirelens.operators import salary as SA
from hirelens.operators import shortlist as SL
from hirelens.sources import companies as SC
from hirelens.sources import run_files as RF
from hirelens.sources.gazetteer import read_gazetteer
from hirelens.sources.salary import read_salary_lookup


def test_role_preset_file(spark, tmp_path):
    f = tmp_path / "role.json"
    f.write_text(json.dumps({"name": "cooks", "levels": ["mid"], "include": [r"\bchef\b", "cook"], "exclude": ["pastry"]}))
    preset = RF.load_role_preset(spark, str(f))
    rows = [("Head Chef", "mid", True), ("Pastry Cook", "mid", False), ("Chef", "senior", False), ("Chefchen", "mid", False), ("échef", "mid", True)]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, l string")
    assert [r[0] for r in df.select(role_match("t", "l", preset)).collect()] == [r[2] for r in rows]
    f.write_text('{"name": "empty"}')
    with pytest.raises(ValueError):
        RF.load_role_preset(spark, str(f))
    with pytest.raises(FileNotFoundError):
        RF.load_role_preset(spark, str(tmp_path / "none.json"))


def test_dead_slugs(spark, tmp_path):
    dead = spark.createDataFrame([("Lever", f"s{i}") for i in range(30)] + [("iCIMS", "x"), ("iCIMS", "x")], "platform string, slug string")
    path = RF.write_dead(dead, str(tmp_path / "dead"), slugs_per_file=7)
    assert {tuple(r) for r in RF.read_dead(spark, path).collect()} == {tuple(r) for r in dead.collect()}
    (tmp_path / "dead" / "platform=ashby").mkdir()
    (tmp_path / "dead" / "platform=ashby" / "broken.txt").write_text('["torn')
    assert RF.read_dead(spark, path).where("platform = 'Ashby'").count() == 0
    assert RF.read_dead(spark, str(tmp_path / "nothing")).count() == 0


def test_shortlist_file(spark, tmp_path):
    jobs = spark.createDataFrame([("Lever", "b", "b", "Cloud Engineer", "mid"), ("Lever", "a", "a", "Cloud Engineer", "mid"),
                                  ("Other", "o", "o", "Cloud Engineer", "mid"), (None, "n", "n", "Cloud Engineer", "mid"),
                                  ("Workday", "w", None, "Cloud Engineer", "mid"), ("iCIMS", None, None, "Cloud Engineer", "mid"),
                                  ("Ashby", "z", "z", "Gardener", "mid")],
                                 "ats string, company string, company_slug string, title string, skill_level string")
    shortlist, stats = SL.build_shortlist(jobs)
    by = {r.platform: (r.matched_jobs, r.unresolved) for r in stats.collect()}
    assert by == {"lever": (2, 0), "other": (1, 0), None: (1, 0), "workday": (1, 1), "icims": (1, 1)}
    path = RF.write_shortlist(shortlist, stats, str(tmp_path / "short"), dt.datetime(2030, 5, 6))
    text = json.loads("".join(p.read_text() for p in (tmp_path / "short").glob("part-*")))
    assert text["platforms"] == {"lever": ["a", "b"]} and text["matched_jobs"] == 6 and text["generated_at"] == "2030-05-06T00:00:00Z"
    slugs, about = RF.read_shortlist(spark, path)
    assert sorted(tuple(r) for r in slugs.collect()) == [("lever", "a"), ("lever", "b")] and about.first().matched_jobs == 6
    assert RF.read_shortlist(spark, None) is None and RF.read_shortlist(spark, str(tmp_path / "gone")) is None


def test_shortlist_matches_the_postings_once(spark):
    jobs = spark.createDataFrame([("Lever", "a", "Cloud Engineer", "mid"), ("Workday", None, "Cloud Engineer", "mid")],
                                 "ats string, company_slug string, title string, skill_level string").selectExpr("*", "company_slug AS company")
    for df in SL.build_shortlist(jobs):
        assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_salary_lookup_file(spark, tmp_path):
    f = tmp_path / "salary.json"
    value = lambda m: {"p25": m - 1, "median": m, "p75": m + 1, "n": 3}
    f.write_text(json.dumps({"primary": {"acme|cook|mid": value(50)}, "fallback": {"cook|mid": value(40)}}, indent=1))
    primary, fallback = read_salary_lookup(spark, str(f))
    jobs = spark.createDataFrame([("Acme", "Cook", "mid"), ("Beta", "Cook", None), ("Beta", "Smith", "mid")], "company string, title string, skill_level string")
    got = [(r.salary.median if r.salary else None, r.salary_source) for r in SA.enrich_salary(jobs, primary, fallback).orderBy("company", "title").collect()]
    assert got == [(50, "primary"), (40, "fallback"), (None, None)]
    assert [t.count() for t in read_salary_lookup(spark, str(tmp_path / "none.json"))] == [0, 0]


def test_gazetteer_file_first_row_wins(spark, tmp_path):
    f = tmp_path / "places.json"
    f.write_text(json.dumps({"schema": ["country", "lat", "city", "lng", "admin", "population"],
                             "data": [["XA", 1.5, "Oldtown", 2.5, "N", 10], ["XB", 3, "Oldtown", 4, "S", 20], [None, 5, "Lost", 6, None, 0], ["XC", 7, "", 8, "", 1]]}))
    gaz = read_gazetteer(spark, str(f))
    assert [(r.city, r.admin, r.country, r.lat) for r in gaz.orderBy("pos").collect()] == [
        ("Oldtown", "N", "XA", 1.5), ("Oldtown", "S", "XB", 3.0), ("Lost", None, None, 5.0), ("", "", "XC", 7.0)]
    maps = G.gazetteer_maps(gaz)
    assert {r.city_n: r.xy.lat for r in maps["city"].collect()} == {"oldtown": 1.5, "lost": 5.0}
    assert {r.city_n: r.country for r in maps["city_to_country"].collect()} == {"oldtown": "XA"}


def test_missing_company_list_is_empty(spark, tmp_path):
    for kind in ("flat", "paylocity"):
        got = SC.read_companies(spark, str(tmp_path / "none"), kind)
        assert got.columns == ["slug", "name"] and got.count() == 0


def test_company_lists_of_several_arrays(spark, tmp_path):
    df = spark.range(0, 50).selectExpr("id AS c_custkey", "concat('s', id) AS slug", "concat('N &amp; ', id) AS name")
    for kind in ("flat", "paylocity"):
        path = SC.write_companies(df, str(tmp_path / kind), kind, chunk_rows=9)
        got = SC.read_companies(spark, path, kind).collect()
        assert {r.slug for r in got} == {f"s{i}" for i in range(50)}
        assert {r.name for r in got} == ({None} if kind == "flat" else {f"N & {i}" for i in range(50)})
    (tmp_path / "pretty.json").write_text(json.dumps(["a", "b"], indent=2))
    assert {r.slug for r in SC.read_companies(spark, str(tmp_path / "pretty.json")).collect()} == {"a", "b"}
