"""Location resolution: every parse branch on the fixture strings."""

import pytest

from hirelens.operators import geo as G
from hirelens.plans import fixtures as fx

EXPECTED = {
    "Remote - US": (True, None, "US"), "Remote, Canada": (True, None, "CA"),
    "Remote (US time zones)": (True, None, "US"), "Work from Home - Arkansas": (True, None, "US"),
    "anywhere": (True, None, None), "3 locations": (False, None, None), "Not Specified": (False, None, None),
    "": (False, None, None), None: (False, None, None),
    "Austin, TX": (False, 30.2672, "US"), "Austin TX": (False, 30.2672, "US"),
    "London": (False, 51.5074, "GB"), "London, UK": (False, 51.5074, "GB"),
    "Berlin, DE": (False, 52.52, "DE"),              # state code contradicted by the gazetteer
    "Cork, IN": (False, 51.8985, "IE"),
    "Houston": (False, 29.7633, "US"),               # famous city pinned to TX, not the first row
    "Springfield": (False, 39.7817, "US"), "San Jose": (False, 37.3382, "US"), "Paris": (False, 48.8566, "FR"),
    "Dublin": (False, 53.3498, "IE"),
    "Omaha, NE": (False, 41.2586, "US"),             # NE expands to 'northeast' on both sides
    "Brooklyn, NY": (False, 40.7128, "US"),          # borough -> New York City
    "NYC": (False, 40.7128, "US"), "Bangalore": (False, 12.9716, "IN"),
    "Montréal, QC": (False, 45.5017, "CA"), "St. Paul, MN": (False, 44.9537, "US"),
    "Ft. Worth, TX": (False, 32.7555, "US"), "Chicago HQ, IL": (False, 41.8781, "US"),
    "Seattle, WA, USA": (False, 47.6062, "US"), "Hybrid in Toronto, Canada": (False, 43.6532, "CA"),
    "Toronto (Main Office), ON": (False, 43.6532, "CA"), "Lagos, Nigeria": (False, 6.5244, "NG"),
    "France": (False, None, "FR"),
    "USA-Illinois-Chicago": (False, None, "US"),     # free-text scan of dash-delimited parts
    "Polaris, OH 43210": (False, None, "US"),        # state + ZIP
    "Wilmington NC USA": (False, None, "US"),        # spelled-out alias as a word
}


@pytest.fixture(scope="module")
def resolved(spark):
    maps = G.gazetteer_maps(fx.gazetteer(spark, "/root/testdata/sf0.001"))
    locs = spark.createDataFrame([(s,) for s in EXPECTED], "location string")
    return {r["location"]: (r["remote"], r["lat"], r["country"]) for r in G.resolve_distinct(locs, maps).collect()}


@pytest.mark.parametrize("loc", list(EXPECTED))
def test_branch(resolved, loc):
    assert resolved[loc] == EXPECTED[loc]


def test_first_row_wins(spark):
    maps = G.gazetteer_maps(fx.gazetteer(spark, "/root/testdata/sf0.001"))
    row = maps["city"].filter("city_n = 'houston'").collect()[0]
    assert row["xy"]["lat"] == 37.3265   # the Missouri row comes first in the file


def test_backfill_only_fills_missing(spark):
    maps = G.gazetteer_maps(fx.gazetteer(spark, "/root/testdata/sf0.001"))
    df = spark.createDataFrame([(1, "London", None), (2, "London", "CA"), (3, "nowhere land", None)],
                               "job_id long, location string, country string")
    out, summary, top = G.backfill_country(df, maps)
    got = {r["job_id"]: r["country"] for r in out.collect()}
    assert got == {1: "GB", 2: "CA", 3: None}
    s = summary.collect()[0]
    assert (s["resolved"], s["already_set"], s["unresolved"]) == (1, 1, 1)
    forced, _, _ = G.backfill_country(df, maps, force=True)
    assert {r["job_id"]: r["country"] for r in forced.collect()}[2] == "GB"
