"""String helpers that stay JVM-side (built-in functions only), plus the two
Arrow-batched UDFs the built-ins cannot express (Unicode NFD accent stripping
and HTML entity unescaping)."""

from __future__ import annotations

import html as _html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters a browser-side RegExp escaper protects (the JS escapeRegex set).
_REGEX_SPECIALS = set(".*+?^${}()|[]\\")


def escape_regex(term: str) -> str:
    """Escape a literal for use inside a Java (and RE2) regular expression."""
    return "".join("\\" + ch if ch in _REGEX_SPECIALS else ch for ch in term)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip all leading/trailing whitespace (Python ``str.strip`` / JS ``trim``),
    not just spaces as ``F.trim`` does."""
    return F.regexp_replace(col_of(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    """The reference treats '' as falsy; SQL does not. nullif before coalesce."""
    return F.nullif(col_of(c), F.lit(""))


_WORD = "[A-Za-z0-9_]"


def ascii_boundaries(pattern: str) -> str:
    """``\\b`` as browsers read it, between ASCII word characters and the rest: Java's
    also counts accented letters as parts of a word."""
    either = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
    return pattern.replace(r"\b", either)


def word_match(c, term: str) -> Column:
    """Whole-term, case-insensitive match: ``\\b<term>\\b`` (ASCII boundaries) with the
    term taken literally. Empty term = no filter (True)."""
    term = (term or "").strip().lower()
    if not term:
        return F.lit(True)
    return F.lower(F.coalesce(col_of(c), F.lit(""))).rlike(ascii_boundaries(r"\b" + escape_regex(term) + r"\b"))


def any_contains(c, terms: list[str]) -> Column:
    """True if the text contains any of the literal terms (substring, not word)."""
    lc = F.coalesce(col_of(c), F.lit(""))
    out = F.lit(False)
    for t in terms:
        out = out | lc.contains(t)
    return out


def split_terms(text: str | None) -> list[str]:
    """Comma-separated keyword list: trimmed, blanks dropped (order kept)."""
    return [t.strip() for t in (text or "").split(",") if t.strip()]


def fuzzy_match(c, term: str, threshold: float = 0.75) -> Column:
    """Substring match, or any ``\\W+``-separated word whose normalised
    Levenshtein similarity to the term is >= threshold."""
    term = (term or "").lower()
    if not term:
        return F.lit(True)
    text = F.lower(F.coalesce(col_of(c), F.lit("")))
    n = len(term)

    def close(w: Column) -> Column:
        max_len = F.greatest(F.length(w), F.lit(n))
        sim = F.lit(1.0) - F.levenshtein(F.lit(term), w) / max_len
        return (F.length(w) > 0) & (sim >= F.lit(threshold))

    return text.contains(term) | F.exists(F.split(text, r"\W+"), close)


def title_case(c) -> Column:
    """Python ``str.title()``: upper-case a letter that follows a non-letter,
    lower-case every other letter (``initcap`` differs after digits and
    apostrophes). Done with a regex split into letter runs, all JVM-side."""
    s = col_of(c)
    # Tokens alternate letter runs and non-letter runs; capitalise each letter run.
    parts = F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), 1)

    def cap(p: Column) -> Column:
        first = F.substring(p, 1, 1)
        # full titlecase mapping: a leading sharp s becomes 'Ss', not 'SS'
        head = F.when(first == "ß", F.lit("Ss")).otherwise(F.upper(first))
        return F.when(p.rlike(r"^\p{L}"), F.concat(head, F.lower(F.substr(p, F.lit(2))))).otherwise(p)

    return F.when(s.isNotNull(), F.array_join(F.transform(parts, cap), ""))


def url_title(url) -> Column:
    """Title from a job URL: the path segment after ``/jobs/<id>/``,
    percent-decoded ('+' kept literally), dashes to spaces, stripped, title-cased.
    Null when there is no such segment."""
    u = col_of(url)
    tail = F.element_at(F.split(u, "/jobs/"), -1)
    parts = F.split(tail, "/")
    seg = F.when(F.size(parts) >= 2, F.element_at(parts, 2))
    # a '+' and a '%' that begins no escape stand for themselves
    protected = F.regexp_replace(F.replace(seg, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.coalesce(F.try_url_decode(protected), seg)
    return F.when(u.contains("/jobs/") & ~u.endswith("/jobs/intro") & seg.isNotNull(),
                  title_case(strip_ws(F.replace(decoded, F.lit("-"), F.lit(" ")))))


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """HTML entity unescape (no built-in equivalent); Arrow-batched."""
    return s.map(lambda v: None if v is None else _html.unescape(v))


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Unicode NFD, then drop combining marks (category Mn)."""
    def one(v):
        if v is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFD", v) if unicodedata.category(ch) != "Mn")
    return s.map(one)
