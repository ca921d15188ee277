"""Row classifiers as native Column expressions (one codegen'd expression per
call; no Python in the hot path)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import presets
from .text import ascii_boundaries, blank_to_null, col_of, strip_ws


def tier_score(title, rules=None) -> Column:
    """Sum of the weights of every rule whose pattern occurs in lower(title).
    Python-origin patterns run with ``(?U)`` so ``\\b``/``\\s``/``\\d`` are Unicode."""
    rules = rules or presets.TIER_RULES
    t = F.lower(F.coalesce(col_of(title), F.lit("")))
    score = F.lit(0)
    for pattern, weight in rules:
        score = score + F.when(t.rlike("(?U)" + pattern), F.lit(weight)).otherwise(F.lit(0))
    return score


def tier_of_score(s: Column) -> Column:
    """Bucket a tier score: <= -50 intern, <= -5 entry, >= 15 senior, else mid."""
    return (F.when(s <= presets.TIER_INTERN_MAX, "intern")
            .when(s <= presets.TIER_ENTRY_MAX, "entry")
            .when(s >= presets.TIER_SENIOR_MIN, "senior")
            .otherwise("mid"))


def tier(title, rules=None) -> Column:
    """intern / entry / mid / senior. The score is computed once (bound through a
    one-element array) so the 21 regexes are not repeated in each CASE branch."""
    return F.transform(F.array(tier_score(title, rules)), tier_of_score)[0]


def _minimal_terms(terms: list[str]) -> list[str]:
    """A term that contains another term can never change a substring test."""
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def is_recruiter(company, terms=None) -> Column:
    """True when lower(company) contains any recruiter term (substring)."""
    terms = _minimal_terms(list(terms or presets.RECRUITER_TERMS))
    c = F.lower(F.coalesce(col_of(company), F.lit("")))
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


# a word boundary, then a word character or a group; no alternatives outside plain groups
_HOISTED = re.compile(r"\\b(?=[\w(])(?:[\w -]|\\[bs.+#]|\[[ -]+\]|\((?:\?:)?[\w -]+(?:\|[\w -]+)*\)|(?<=[\w\])])\?)+")


def one_of(patterns: list[str]) -> str:
    """Alternation of patterns. The boundary that most of them begin with is asked once a position, not once for each of them."""
    words = [p[2:] for p in patterns if _HOISTED.fullmatch(p)]
    rest = [p for p in patterns if not _HOISTED.fullmatch(p)]
    return "|".join(([r"\b(?:" + "|".join(words) + ")"] if words else []) + rest)


def role_match(title, level, preset=None) -> Column:
    """Role preset: non-empty title, level in the preset's set (null level counts
    as ''), include alternation hits, exclude alternation does not.
    Patterns are read as browsers do (case-insensitive, ASCII word boundaries), title only."""
    preset = preset or presets.ROLE_PRESET
    t = F.coalesce(col_of(title), F.lit(""))
    cond = t != F.lit("")
    levels = list(preset.get("levels") or [])
    if levels:
        cond = cond & F.coalesce(col_of(level), F.lit("")).isin(levels)
    cond = cond & t.rlike("(?i)" + ascii_boundaries(one_of(preset["include"])))
    if preset.get("exclude"):
        cond = cond & ~t.rlike("(?i)" + ascii_boundaries(one_of(preset["exclude"])))
    return cond


def relative_date(text, run_date) -> Column:
    """'Posted Today' / 'N days' / 'N weeks' / 'N months' (30 days each) -> DATE
    relative to ``run_date``; anything else -> NULL. Checks run in that order."""
    t = F.lower(strip_ws(col_of(text)))
    rd = run_date if isinstance(run_date, Column) else F.to_date(F.lit(str(run_date)))

    def n(unit: str) -> Column:
        return F.regexp_extract(t, r"(?U)(\d+)\s+" + unit, 1)

    return (F.when(t.contains("today"), rd)
            .when(n("day") != "", F.date_sub(rd, n("day").cast("int")))
            .when(n("week") != "", F.date_sub(rd, n("week").cast("int") * 7))
            .when(n("month") != "", F.date_sub(rd, n("month").cast("int") * 30)))


def dedup_key(url="url", ats="ats", company="company", job_id="id", title="title") -> Column:
    """Merge key: Workday URLs with /jobs/<digits> -> workday:company:id;
    Paylocity -> paylocity:id, else paylocity:company:title; otherwise the URL.
    An empty key means the row is skipped by the merge."""
    u = F.coalesce(col_of(url), F.lit(""))
    a = col_of(ats)
    wd_id = F.regexp_extract(u, r"/jobs/(\d+)", 1)
    comp = F.coalesce(col_of(company), F.lit(""))
    jid = blank_to_null(col_of(job_id).cast("string"))
    return (F.when((a == "Workday") & (wd_id != ""), F.concat_ws(":", F.lit("workday"), comp, wd_id))
            .when((a == "Paylocity") & jid.isNotNull(), F.concat(F.lit("paylocity:"), jid))
            .when(a == "Paylocity", F.concat_ws(":", F.lit("paylocity"), comp,
                                                F.coalesce(col_of(title), F.lit(""))))
            .otherwise(u))


def clean_reason(title="title", url="url", absolute_url="absolute_url",
                 company="company", company_slug="company_slug") -> Column:
    """First failing reason of the clean step, or NULL when the row is kept."""
    t = F.lower(strip_ws(F.coalesce(col_of(title), F.lit(""))))
    has_url = F.coalesce(blank_to_null(col_of(url)), blank_to_null(col_of(absolute_url))).isNotNull()
    has_company = F.coalesce(blank_to_null(col_of(company)), blank_to_null(col_of(company_slug))).isNotNull()
    return (F.when(t.isin(presets.INVALID_TITLES), "no_title")
            .when(~has_url, "no_url")
            .when(~has_company, "no_company"))
