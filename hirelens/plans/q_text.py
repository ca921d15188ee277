"""Registered queries over raw web pages: title extraction with HTML entity
unescaping, title-from-URL, and embedded-blob extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import html_unescape, url_title
from ..session import read_table
from ..sources.raw import extract_blob
from . import sqlgen as g
from .registry import register

TITLE_RE = r"(?s)<title>(.*?)</title>"


def _pages(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", "url", "html")


def _raw_title(html):
    return F.regexp_extract(html, TITLE_RE, 1)


# The entities present in the page corpus; &amp; last so nothing is unescaped twice.
_UNESCAPE_SQL = "replace(replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), " \
                "'&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&amp;', '&')"


@register("html_unescape", f"""SELECT page_id, {_UNESCAPE_SQL.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title
FROM pages""")
def q_html_unescape(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", html_unescape(_raw_title(F.col("html"))).alias("title"))


def _job_url(page_id, title):
    """A sitemap-style job URL whose last segment is the page title slug
    ('%' dropped, '&' percent-encoded, spaces to dashes)."""
    slug = F.replace(F.replace(F.replace(F.lower(title), F.lit("%"), F.lit("")), F.lit("&"), F.lit("%26")),
                     F.lit(" "), F.lit("-"))
    slug = F.when(page_id % 3 == 0, F.concat(slug, F.lit("-50%"))).otherwise(slug)  # a '%' that is no escape
    return F.concat(F.lit("https://careers-pages.icims.com/jobs/"), page_id.cast("string"), F.lit("/"), slug, F.lit("/job"))


_SLUG_SQL = ("(replace(replace(replace(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '%', ''), '&', '%26'), ' ', '-')"
             " || CASE WHEN page_id % 3 = 0 THEN '-50%' ELSE '' END)")


@register("url_title", f"""SELECT page_id, 'https://careers-pages.icims.com/jobs/' || CAST(page_id AS VARCHAR) || '/' || {_SLUG_SQL} || '/job' AS job_url,
 {g.pytitle("trim(replace(url_decode(" + _SLUG_SQL + "), '-', ' '))")} AS title FROM pages""")
def q_url_title(spark, sf):
    p = _pages(spark, sf)
    u = p.select("page_id", _job_url(F.col("page_id"), _raw_title(F.col("html"))).alias("job_url"))
    return u.select("page_id", "job_url", url_title("job_url").alias("title"))


@register("extract_blob", r"""SELECT page_id, CAST(nullif(regexp_extract(html, 'track\((\d+)\);', 1), '') AS BIGINT) AS tracked
FROM pages""")
def q_extract_blob(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", extract_blob(F.col("html"), r"track\((\d+)\);").cast("bigint").alias("tracked"))


@register("fuzzy_part_name", """SELECT p_partkey, p_name FROM part
WHERE contains(lower(coalesce(p_name, '')), 'widgit') OR len(list_filter(
  regexp_split_to_array(lower(coalesce(p_name, '')), '[^A-Za-z0-9_]+'),
  lambda w: length(w) > 0 AND 1.0 - levenshtein('widgit', w) / greatest(length(w), 6) >= 0.75)) > 0""")
def q_fuzzy_part_name(spark, sf):
    """Fuzzy term match (substring, or a word within 25 % edit distance) over
    every part name."""
    from ..functions.text import fuzzy_match
    p = read_table(spark, sf, "part").select("p_partkey", "p_name")
    return p.filter(fuzzy_match("p_name", "widgit"))


@register("keyword_documents", """SELECT doc_id, lang FROM documents
WHERE (contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'password'))
  AND NOT (contains(lower(coalesce(text, '')), 'lorem'))""")
def q_keyword_documents(spark, sf):
    """Include / exclude keyword lists (substring, case-insensitive) over whole
    document texts."""
    from ..functions.text import any_contains, split_terms
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    t = F.lower(F.coalesce(F.col("text"), F.lit("")))
    return d.filter(any_contains(t, split_terms("license, password"))
                    & ~any_contains(t, split_terms("lorem"))).select("doc_id", "lang")
