"""Title tiers, recruiter flag, role preset, relative dates, clean reasons."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelens.functions.classify import clean_reason, is_recruiter, relative_date, role_match, tier, tier_score

TIERS = [
    ("Senior Software Engineer", "senior"), ("Software Engineer II", "mid"), ("Software Engineer I", "entry"),
    ("Clerk 1 - Nights", "entry"), ("Engineer 1-2", "mid"), ("Backend Developer Intern", "intern"),
    ("Junior DevOps Engineer", "entry"), ("Staff Site Reliability Engineer", "senior"),
    ("VP of Engineering", "senior"), ("Nurse Assistant", "entry"), ("Platform Engineer", "mid"),
    ("Entry Level Analyst", "entry"), ("Sr. Data Scientist", "senior"), ("Associate Consultant", "entry"),
    ("Level 3 Support", "mid"), ("Engr 5", "senior"), ("Graduate Trainee", "entry"), ("", "mid"), (None, "mid"),
]


def test_tiers(spark):
    df = spark.createDataFrame([(t,) for t, _ in TIERS], "title string")
    got = [r[0] for r in df.select(tier("title")).collect()]
    assert got == [e for _, e in TIERS]


def test_lookahead_rule(spark):
    df = spark.createDataFrame([("web developer i",), ("developer i-2",), ("developer 1 - remote",), ("i",)], "t string")
    assert [r[0] for r in df.select(tier_score("t")).collect()] == [-15, 5, 0, -15]


def test_recruiter(spark):
    df = spark.createDataFrame([("Acme Staffing",), ("talentgroup",), ("Globex",), (None,)], "c string")
    assert [r[0] for r in df.select(is_recruiter("c")).collect()] == [True, True, False, False]


def test_role_match(spark):
    rows = [("Cloud Engineer", "mid", True), ("Senior Software Engineer", "senior", False),
            ("Sales Engineer", "mid", False), ("Software Engineer", None, False), ("", "mid", False),
            ("Field Engineer, Kubernetes", "entry", False), ("React Developer", "entry", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "title string, lvl string")
    assert [r[0] for r in df.select(role_match("title", "lvl")).collect()] == [e for *_, e in rows]


@pytest.mark.parametrize("run", [dt.date(2024, 3, 1), dt.date(2030, 1, 4)])
def test_relative_date(spark, run):
    """Singular and plural, the order of the checks, leap days and year ends; open-ended or unknown texts give nothing."""
    back = {"just posted today, 5 days ago": 0, "TODAY": 0, "  opened 1 day ago": 1, "9 days, 2 weeks and 1 month": 9, "3 weeks or 2 months": 21,
            "posted 11 Months": 330, "100 week": 700, "0 days": 0}
    none = ["yesterday", "days", "a week ago", "12+ days ago", "3 hours", "2 years ago", "   ", "", None]
    df = spark.createDataFrame([(t,) for t in [*back, *none]], "t string")
    got = {r.t: r.d for r in df.select("t", relative_date("t", run).alias("d")).collect()}
    assert got == {t: run - dt.timedelta(days=n) for t, n in back.items()} | dict.fromkeys(none)


def test_clean_reasons_in_order(spark):
    rows = [(" N/A ", "u", None, "c", None, "no_title"), ("Eng", "", "", "c", None, "no_url"),
            ("Eng", None, "a", None, "", "no_company"), ("Eng", None, "a", None, "slug", None),
            ("unknown", None, None, None, None, "no_title")]
    df = spark.createDataFrame([r[:5] for r in rows], "title string, url string, absolute_url string, company string, company_slug string")
    assert [r[0] for r in df.select(clean_reason()).collect()] == [r[5] for r in rows]


RULES = [("director", 50), ("principal", 40), ("lead", 30), ("senior", 20), ("manager", 15), ("iii", 15),
         ("level 5", 15), ("engr 4", 15), ("counsel", 20), ("charge", 20), ("ii", 5), ("level 3", 5),
         ("associate", -10), ("junior", -20), ("entry level", -25), ("i", -15), ("trainee", -25), ("clerk", -15),
         ("resident", -15), ("aide", -10), ("internship", -100)]


def test_each_rule_alone(spark):
    df = spark.createDataFrame([(t,) for t, _ in RULES], "t string")
    assert [r[0] for r in df.select(tier_score("t")).collect()] == [w for _, w in RULES]


def test_thresholds(spark):
    cases = [("graduate entry level", "intern"),      # -50
             ("trainee junior", "entry"),            # -45
             ("ii aide", "entry"),                   # -5
             ("analyst", "mid"),                     # 0
             ("charge aide", "mid"),                 # 10
             ("manager", "senior")]                  # 15
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(tier("t")).collect()] == [e for _, e in cases]


def test_leading_boundary_is_asked_once(spark):
    from hirelens.functions.classify import one_of
    from hirelens.functions.text import ascii_boundaries

    patterns = [r"\bfoo (bar|baz)\b", r"\bred[ -]?ish\b", r"\ba|b\b", "plain", r"\bsenior\b"]
    joined = one_of(patterns)
    assert joined.startswith(r"\b(?:foo (bar|baz)\b|red[ -]?ish\b|senior\b)") and r"\ba|b\b" in joined
    texts = ["foo bar", "xfoo bar", "foo bark", "red-ish", "infrared ish", "a", "xb", "xbx", "explained", "Senior\u00e9", "\u00e9senior", "seniors", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = [df.select(df.t.rlike("(?i)" + ascii_boundaries(p))).collect() for p in ("|".join(patterns), joined)]
    assert both[0] == both[1] and {r[0] for r in both[0]} == {True, False}
