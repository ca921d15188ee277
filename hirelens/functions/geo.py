"""Location strings -> (remote, city, admin, country) as native Column
expressions: token arrays, higher-order functions and literal lookup maps.
Only Unicode NFD accent stripping runs in Python (an Arrow-batched UDF), and
callers apply it to DISTINCT location strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import presets as P
from .text import col_of, escape_regex, strip_accents, strip_ws


def lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _get(m: Column, k: Column) -> Column:
    return F.try_element_at(m, k)


def _has(m: Column, k: Column) -> Column:
    return F.coalesce(F.map_contains_key(m, k), F.lit(False))


def collapse_ws(c: Column) -> Column:
    """``" ".join(s.split())``: trim and collapse all whitespace runs."""
    return strip_ws(F.regexp_replace(c, r"(?U)\s+", " "))


def _any_contains(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def loc_normalize(c, accents_stripped: bool = False) -> Column:
    """NFD + drop combining marks, drop . ' `, lower, collapse whitespace,
    saint -> st, then compass and ft/mt/pt expansions on the space-padded
    string (left-to-right, non-overlapping, in the fixed order)."""
    s = col_of(c) if accents_stripped else strip_accents(col_of(c))
    s = F.regexp_replace(s, "[.'`]", "")
    s = collapse_ws(F.lower(s))
    s = F.when(s.startswith("saint "), F.concat(F.lit("st "), F.substr(s, F.lit(7)))).otherwise(s)
    s = F.replace(s, F.lit(" saint "), F.lit(" st "))
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    for a, b in P.DIRECTION_EXPANSIONS + P.ABBREVIATION_EXPANSIONS:
        padded = F.replace(padded, F.lit(a), F.lit(b))
    return F.when(col_of(c).isNull(), F.lit("")).otherwise(strip_ws(padded))


_REMOTE_WORDS = sorted(set(P.REMOTE_KEYWORDS) | set(P.TIMEZONE_KEYWORDS), key=lambda w: (-len(w), w))


def country_from_remote(n: Column) -> Column:
    """Country named next to a remote keyword: keywords blanked (longest first),
    split on , - — | / ( ), first token that is a country alias (-> code) or a
    US state (-> US)."""
    text = n
    for kw in _REMOTE_WORDS:
        text = F.replace(text, F.lit(kw), F.lit(" "))
    parts = F.transform(F.split(text, "[,\\-—|/()]"), collapse_ws)
    ca, st = lit_map(P.COUNTRY_ALIASES), lit_map(P.US_STATES)
    codes = F.transform(F.filter(parts, lambda p: p != ""),
                        lambda p: F.coalesce(_get(ca, p), F.when(_has(st, p), F.lit("US"))))
    return F.try_element_at(F.filter(codes, lambda x: x.isNotNull()), F.lit(1))


_LONG = sorted((a for a in P.COUNTRY_ALIASES if len(a) >= 3), key=len, reverse=True)
LONG_ALIAS_PATTERN = r"(?iU)\b(" + "|".join(escape_regex(a) for a in _LONG) + r")\b"


def country_from_freetext(raw) -> Column:
    """Exact alias among the parts split on , - – — • | /; else the first
    spelled-out (3+ character) alias anywhere as a whole word."""
    r = col_of(raw)
    ca = lit_map(P.COUNTRY_ALIASES)
    parts = F.transform(F.split(r, "[,\\-–—•|/]+"), lambda p: F.lower(collapse_ws(p)))
    exact = F.try_element_at(F.filter(F.transform(parts, lambda p: _get(ca, p)), lambda x: x.isNotNull()), F.lit(1))
    word = F.lower(F.regexp_extract(r, LONG_ALIAS_PATTERN, 1))
    return F.when(F.coalesce(r, F.lit("")) != "", F.coalesce(exact, _get(ca, word)))


def country_from_address(raw) -> Column:
    """'Polaris, OH 43210': the first 'XX 12345' pair -> US when XX is a state."""
    m = F.lower(F.regexp_extract(F.coalesce(col_of(raw), F.lit("")), r"(?U)\b([A-Za-z]{2})\s+\d{5}(?:-\d{4})?\b", 1))
    return F.when(_has(lit_map(P.US_STATES), m), F.lit("US"))


def _strip_arrangement(n: Column) -> Column:
    out = n
    for p in reversed(P.WORK_ARRANGEMENT_PREFIXES):
        out = F.when(n.startswith(p), F.substr(n, F.lit(len(p) + 1))).otherwise(out)
    return out


_JUNK = "|".join(P.JUNK_TOKEN_SUFFIXES)


def _clean_token(t: Column) -> Column:
    c = collapse_ws(t)
    return strip_ws(F.regexp_replace(c, f"(^| )(?:{_JUNK})(?: (?:{_JUNK}))*$", ""))


def _last_index(arr: Column, m: Column) -> Column:
    """0-based index of the LAST element that is a key of ``m`` (NULL if none)."""
    return F.array_max(F.filter(F.transform(arr, lambda t, i: F.when(_has(m, t), i)), lambda x: x.isNotNull()))


def _drop_at(arr: Column, idx: Column) -> Column:
    return F.filter(arr, lambda t, i: i != idx)


def parse_locations(df: DataFrame, norm: str, out: str = "parsed") -> DataFrame:
    """Add ``<out>_remote``, ``<out>_city``, ``<out>_admin``, ``<out>_country``
    parsed from the NORMALISED location column ``norm``.

    Branch order: garbage; remote keywords; time-zone words; city alias of the
    whole string; 'city ST'; lone country; trailing country; US state; then
    city / admin from what is left. Each stage is its own column so every
    expression refers to the previous stage by attribute (no re-inlining)."""
    ca, st, cit = lit_map(P.COUNTRY_ALIASES), lit_map(P.US_STATES), lit_map(P.CITY_ALIASES)
    n = F.col(norm)
    d = df.withColumn("_lp_empty", n.isNull() | n.isin(P.GARBAGE_LOCATIONS))
    d = d.withColumn("_lp_remote", _any_contains(n, P.REMOTE_KEYWORDS) | _any_contains(n, P.TIMEZONE_KEYWORDS))
    d = d.withColumn("_lp_s", _strip_arrangement(n))
    s = F.col("_lp_s")
    s = strip_ws(F.regexp_replace(s, r"(?U)\s*\([^)]*\)\s*", " "))
    s = F.replace(F.replace(s, F.lit("- remote"), F.lit("")), F.lit("— remote"), F.lit(""))
    d = d.withColumn("_lp_s", F.regexp_replace(s, "^[ ,\\-—]+|[ ,\\-—]+$", ""))
    raw_tokens = F.filter(F.split("_lp_s", ","), lambda t: strip_ws(t) != "")
    d = d.withColumn("_lp_t0", F.filter(F.transform(raw_tokens, _clean_token), lambda t: t != ""))
    t0 = F.col("_lp_t0")
    d = d.withColumn("_lp_t", F.filter(t0, lambda t, i: (i == 0) | (t != F.try_element_at(t0, F.greatest(i, F.lit(1))))))
    toks = F.col("_lp_t")
    d = d.withColumn("_lp_joined", F.array_join(toks, " ")).withColumn("_lp_n", F.size(toks))
    # 'city ST' written without a comma
    d = d.withColumn("_lp_w", F.split(F.try_element_at(toks, F.lit(1)), " "))
    words = F.col("_lp_w")
    d = d.withColumn("_lp_lw", F.try_element_at(words, F.lit(-1)))
    split_state = (F.col("_lp_n") == 1) & (F.size(words) >= 2) & _has(st, F.col("_lp_lw"))
    d = d.withColumn("_lp_t2", F.when(split_state, F.array(F.array_join(F.slice(words, 1, F.size(words) - 1), " "),
                                                            F.col("_lp_lw"))).otherwise(toks))
    t2 = F.col("_lp_t2")
    d = d.withColumn("_lp_lone", (F.size(t2) == 1) & _has(ca, F.try_element_at(t2, F.lit(1))))
    d = d.withColumn("_lp_ci", F.when(F.size(t2) > 1, _last_index(t2, ca)))
    ci = F.col("_lp_ci")
    d = d.withColumn("_lp_c", F.when(ci.isNotNull(), _get(ca, F.element_at(t2, ci + 1))))
    d = d.withColumn("_lp_t3", F.when(ci.isNotNull(), _drop_at(t2, ci)).otherwise(t2))
    t3, country = F.col("_lp_t3"), F.col("_lp_c")
    d = d.withColumn("_lp_si", F.when((F.size(t3) > 1) & (country.isNull() | (country == "US")), _last_index(t3, st)))
    si = F.col("_lp_si")
    d = d.withColumn("_lp_st", F.when(si.isNotNull(), _get(st, F.element_at(t3, si + 1))))
    d = d.withColumn("_lp_t4", F.when(si.isNotNull(), _drop_at(t3, si)).otherwise(t3))
    t4, state = F.col("_lp_t4"), F.col("_lp_st")
    k = F.size(t4)
    country2 = F.when(state.isNotNull() & country.isNull(), F.lit("US")).otherwise(country)
    admin = F.when(state.isNotNull(), state).when(k >= 2, F.element_at(t4, -1))
    city = (F.when(k == 0, F.lit(None))
            .when(state.isNull() & (k >= 2), F.array_join(F.slice(t4, 1, k - 1), " "))
            .otherwise(F.element_at(t4, 1)))
    d = d.withColumn("_lp_city", city)
    city = F.coalesce(_get(cit, F.col("_lp_city")), F.col("_lp_city"))

    joined = F.col("_lp_joined")
    dead = F.col("_lp_empty") | F.col("_lp_remote") | (F.col("_lp_s") == "") | (F.col("_lp_n") == 0)
    alias_hit = _has(cit, joined)
    d = d.withColumn("_lp_dead", dead).withColumn("_lp_alias", alias_hit)
    dead, alias_hit, lone = F.col("_lp_dead"), F.col("_lp_alias"), F.col("_lp_lone")
    # four plain columns (a struct here would be re-inlined field by field)
    d = d.withColumn(f"{out}_remote", ~F.col("_lp_empty") & F.col("_lp_remote"))
    d = d.withColumn(f"{out}_city", F.when(dead, F.lit(None)).when(alias_hit, _get(cit, joined))
                     .when(lone, F.lit(None)).otherwise(city))
    d = d.withColumn(f"{out}_admin", F.when(dead | alias_hit | lone, F.lit(None)).otherwise(admin))
    d = d.withColumn(f"{out}_country", F.when(F.col("_lp_empty"), F.lit(None))
                     .when(F.col("_lp_remote"), country_from_remote(n))
                     .when(dead | alias_hit, F.lit(None))
                     .when(lone, _get(ca, F.element_at(t2, 1))).otherwise(country2))
    return d.drop(*[c for c in d.columns if c.startswith("_lp_")])


def is_remote(c) -> Column:
    """Remote keyword in the normalised string (garbage strings are not remote)."""
    n = loc_normalize(c)
    return F.when(n.isin(P.GARBAGE_LOCATIONS), F.lit(False)).otherwise(_any_contains(n, P.REMOTE_KEYWORDS))
