"""DuckDB SQL for the location parser and gazetteer cascade (oracle side)."""

from __future__ import annotations

from .. import presets as P
from . import fixtures as fx
from .sqlgen import _case, q

_REMOTE_WORDS = sorted(set(P.REMOTE_KEYWORDS) | set(P.TIMEZONE_KEYWORDS), key=lambda w: (-len(w), w))
_LONG = sorted((a for a in P.COUNTRY_ALIASES if len(a) >= 3), key=len, reverse=True)
_SPECIALS = set(".*+?^${}()|[]\\")


def _esc(a: str) -> str:
    return "".join("\\" + ch if ch in _SPECIALS else ch for ch in a)


def smap(d: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


CA, ST, CIT = smap(P.COUNTRY_ALIASES), smap(P.US_STATES), smap(P.CITY_ALIASES)
FAM, FAMA = smap(P.FAMOUS_CITY_DEFAULTS), smap(P.FAMOUS_CITY_ADMIN)


def get(m: str, k: str) -> str:
    return f"map_extract_value({m}, {k})"


def has(m: str, k: str) -> str:
    return f"coalesce(map_contains({m}, {k}), false)"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def norm(x: str) -> str:
    s = f"strip_accents({x})"
    s = f"regexp_replace({s}, '[.''`]', '', 'g')"
    s = collapse(f"lower({s})")
    s = f"(CASE WHEN starts_with({s}, 'saint ') THEN 'st ' || ({s})[7:] ELSE {s} END)"
    s = f"replace({s}, ' saint ', ' st ')"
    padded = f"(' ' || {s} || ' ')"
    for a, b in P.DIRECTION_EXPANSIONS + P.ABBREVIATION_EXPANSIONS:
        padded = f"replace({padded}, {q(a)}, {q(b)})"
    return f"(CASE WHEN {x} IS NULL THEN '' ELSE trim({padded}) END)"


def any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def country_from_remote(n: str) -> str:
    t = n
    for kw in _REMOTE_WORDS:
        t = f"replace({t}, {q(kw)}, ' ')"
    parts = f"list_transform(regexp_split_to_array({t}, '[,\\-—|/()]'), lambda p: {collapse('p')})"
    codes = (f"list_transform(list_filter({parts}, lambda p: p <> ''), "
             f"lambda p: coalesce({get(CA, 'p')}, CASE WHEN {has(ST, 'p')} THEN 'US' END))")
    return f"(list_filter({codes}, lambda x: x IS NOT NULL))[1]"


def country_from_freetext(raw: str) -> str:
    parts = f"list_transform(regexp_split_to_array({raw}, '[,\\-–—•|/]+'), lambda p: {get(CA, 'lower(' + collapse('p') + ')')})"
    exact = f"(list_filter({parts}, lambda x: x IS NOT NULL))[1]"
    pat = "(?i)\\b(" + "|".join(_esc(a) for a in _LONG) + ")\\b"
    word = get(CA, f"lower(regexp_extract({raw}, {q(pat)}, 1))")
    return f"(CASE WHEN coalesce({raw}, '') = '' THEN NULL ELSE coalesce({exact}, {word}) END)"


def country_from_address(raw: str) -> str:
    m = f"lower(regexp_extract(coalesce({raw}, ''), '\\b([A-Za-z]{{2}})\\s+\\d{{5}}(?:-\\d{{4}})?\\b', 1))"
    return f"(CASE WHEN {has(ST, m)} THEN 'US' END)"


_JUNK = "|".join(P.JUNK_TOKEN_SUFFIXES)


def _clean_token(t: str) -> str:
    return f"trim(regexp_replace({collapse(t)}, '(^| )(?:{_JUNK})(?: (?:{_JUNK}))*$', ''))"


def _strip_arrangement(n: str) -> str:
    whens = " ".join(f"WHEN starts_with({n}, {q(p)}) THEN ({n})[{len(p) + 1}:]" for p in P.WORK_ARRANGEMENT_PREFIXES)
    return f"(CASE {whens} ELSE {n} END)"


def _last_index(arr: str, m: str) -> str:
    return (f"list_max(list_filter(list_transform({arr}, lambda x, i: CASE WHEN {has(m, 'x')} THEN i END), "
            f"lambda x: x IS NOT NULL))")


def parse_ctes(src: str) -> str:
    """CTEs over ``src`` (a CTE with column ``location``) ending in
    ``parsed(location, n, remote, city, admin, country)``, one row per
    distinct location."""
    garbage = ", ".join(q(g) for g in P.GARBAGE_LOCATIONS)
    return f"""pl0 AS (SELECT DISTINCT location FROM {src}),
pl1 AS (SELECT location, {norm('location')} AS n FROM pl0),
pl2 AS (SELECT *, n IN ({garbage}) AS is_empty,
  {any_contains('n', P.REMOTE_KEYWORDS)} OR {any_contains('n', P.TIMEZONE_KEYWORDS)} AS is_remote,
  {_strip_arrangement('n')} AS s1 FROM pl1),
pl3 AS (SELECT *, regexp_replace(replace(replace(trim(regexp_replace(s1, '\\s*\\([^)]*\\)\\s*', ' ', 'g')), '- remote', ''), '— remote', ''),
  '^[ ,\\-—]+|[ ,\\-—]+$', '', 'g') AS s FROM pl2),
pl4 AS (SELECT *, list_filter(list_transform(list_filter(string_split(s, ','), lambda t: trim(t) <> ''),
  lambda t: {_clean_token('t')}), lambda t: t <> '') AS t0 FROM pl3),
pl5 AS (SELECT *, list_filter(t0, lambda x, i: i = 1 OR x <> t0[i - 1]) AS t FROM pl4),
pl6 AS (SELECT *, array_to_string(t, ' ') AS joined, len(t) AS nt, string_split(t[1], ' ') AS w FROM pl5),
pl7 AS (SELECT *, CASE WHEN nt = 1 AND len(w) >= 2 AND {has(ST, 'w[-1]')}
  THEN [array_to_string(w[1:len(w) - 1], ' '), w[-1]] ELSE t END AS t2 FROM pl6),
pl8 AS (SELECT *, len(t2) = 1 AND {has(CA, 't2[1]')} AS lone,
  CASE WHEN len(t2) > 1 THEN {_last_index('t2', CA)} END AS ci FROM pl7),
pl9 AS (SELECT *, CASE WHEN ci IS NOT NULL THEN {get(CA, 't2[ci]')} END AS c,
  CASE WHEN ci IS NOT NULL THEN list_filter(t2, lambda x, i: i <> ci) ELSE t2 END AS t3 FROM pl8),
pl10 AS (SELECT *, CASE WHEN len(t3) > 1 AND (c IS NULL OR c = 'US') THEN {_last_index('t3', ST)} END AS si FROM pl9),
pl11 AS (SELECT *, CASE WHEN si IS NOT NULL THEN {get(ST, 't3[si]')} END AS stt,
  CASE WHEN si IS NOT NULL THEN list_filter(t3, lambda x, i: i <> si) ELSE t3 END AS t4 FROM pl10),
pl12 AS (SELECT *, len(t4) AS k,
  CASE WHEN stt IS NOT NULL AND c IS NULL THEN 'US' ELSE c END AS country2,
  CASE WHEN stt IS NOT NULL THEN stt WHEN len(t4) >= 2 THEN t4[-1] END AS admin0,
  CASE WHEN len(t4) = 0 THEN NULL WHEN stt IS NULL AND len(t4) >= 2 THEN array_to_string(t4[1:len(t4) - 1], ' ')
   ELSE t4[1] END AS city0 FROM pl11),
parsed AS (
 SELECT location, n,
  CASE WHEN is_empty THEN false WHEN is_remote THEN true ELSE false END AS remote,
  CASE WHEN is_empty OR is_remote OR s = '' OR nt = 0 THEN NULL WHEN {has(CIT, 'joined')} THEN {get(CIT, 'joined')}
   WHEN lone THEN NULL ELSE coalesce({get(CIT, 'city0')}, city0) END AS city,
  CASE WHEN is_empty OR is_remote OR s = '' OR nt = 0 OR {has(CIT, 'joined')} OR lone THEN NULL ELSE admin0 END AS admin,
  CASE WHEN is_empty THEN NULL WHEN is_remote THEN {country_from_remote('n')} WHEN s = '' OR nt = 0 THEN NULL
   WHEN {has(CIT, 'joined')} THEN NULL WHEN lone THEN {get(CA, 't2[1]')} ELSE country2 END AS country
 FROM pl12)"""


def gazetteer_ctes() -> str:
    rows = ", ".join(f"({q(c)}, {q(a)}, {q(k)}, {la}, {ln}, {i})" for i, (c, a, k, la, ln) in enumerate(fx.GAZETTEER))
    agg = "arg_min(lat, pos) AS lat, arg_min(lng, pos) AS lng"
    words = _case("s_suppkey % 4", list(enumerate(fx.TOWN_WORDS)))
    nation = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"""gz0 AS (SELECT * FROM (VALUES {rows}) t(city, admin, country, lat, lng, pos)
 UNION ALL SELECT {nation} || ' ' || {words}, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'R' || (s_suppkey % 3) END, n_name[1:2],
  (s_suppkey * 37 % 180) - 90, (s_suppkey * 91 % 360) - 180, s_suppkey + {len(fx.GAZETTEER)}
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
gz AS (SELECT {norm('city')} AS city_n, {norm('admin')} AS admin_n, nullif(country, '') AS country,
  CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng, pos FROM gz0),
gz1 AS (SELECT * FROM gz WHERE city_n <> ''),
m_cac AS (SELECT city_n, admin_n, country, {agg} FROM gz1 WHERE admin_n <> '' AND country IS NOT NULL GROUP BY 1, 2, 3),
m_cc AS (SELECT city_n, country, {agg} FROM gz1 WHERE country IS NOT NULL GROUP BY 1, 2),
m_ca AS (SELECT city_n, admin_n, {agg} FROM gz1 WHERE admin_n <> '' GROUP BY 1, 2),
m_c AS (SELECT city_n, {agg} FROM gz1 GROUP BY 1),
m_c2c AS (SELECT city_n, arg_min(country, pos) AS country FROM gz1 WHERE country IS NOT NULL GROUP BY 1)"""


def resolve_ctes(src: str) -> str:
    """... ending in ``resolved(location, remote, lat, lng, country)``."""
    boroughs = ", ".join(q(b) for b in P.NYC_BOROUGHS)
    return f"""{parse_ctes(src)},
{gazetteer_ctes()},
r1 AS (SELECT location, remote, lower(admin) AS admin, country AS country0,
  CASE WHEN city IN ({boroughs}) AND lower(admin) = 'ny' THEN 'new york city' ELSE city END AS city FROM parsed),
r2 AS (SELECT r1.*, us.lat AS us_lat, kn.country AS known FROM r1
  LEFT JOIN m_cac us ON us.city_n = r1.city AND us.admin_n = r1.admin AND us.country = 'US'
  LEFT JOIN m_c2c kn ON kn.city_n = r1.city),
r3 AS (SELECT *, CASE WHEN country0 = 'US' AND admin IS NOT NULL AND length(admin) = 2 AND us_lat IS NULL
   AND known IS NOT NULL AND known <> 'US' THEN known ELSE country0 END AS country FROM r2),
r4 AS (SELECT *, CASE WHEN country IS NULL THEN {get(FAM, 'city')} END AS fc, {get(FAMA, 'city')} AS fa FROM r3),
r5 AS (SELECT r4.*, c1.lat AS lat1, c1.lng AS lng1, c2.lat AS lat2, c2.lng AS lng2, c3.lat AS lat3, c3.lng AS lng3,
  c4.lat AS lat4, c4.lng AS lng4, c5.lat AS lat5, c5.lng AS lng5, c6.lat AS lat6, c6.lng AS lng6 FROM r4
  LEFT JOIN m_cac c1 ON c1.city_n = r4.city AND c1.admin_n = r4.admin AND c1.country = r4.country
  LEFT JOIN m_cc c2 ON c2.city_n = r4.city AND c2.country = r4.country
  LEFT JOIN m_ca c3 ON c3.city_n = r4.city AND c3.admin_n = r4.admin
  LEFT JOIN m_cac c4 ON c4.city_n = r4.city AND c4.admin_n = r4.fa AND c4.country = r4.fc
  LEFT JOIN m_cc c5 ON c5.city_n = r4.city AND c5.country = r4.fc
  LEFT JOIN m_c c6 ON c6.city_n = r4.city),
r6 AS (SELECT *, CASE WHEN remote OR city IS NULL OR city = '' THEN 0
   WHEN admin IS NOT NULL AND country IS NOT NULL AND lat1 IS NOT NULL THEN 1
   WHEN country IS NOT NULL AND lat2 IS NOT NULL THEN 2
   WHEN admin IS NOT NULL AND lat3 IS NOT NULL THEN 3
   WHEN fc IS NOT NULL AND fa IS NOT NULL AND lat4 IS NOT NULL THEN 4
   WHEN fc IS NOT NULL AND lat5 IS NOT NULL THEN 5
   WHEN lat6 IS NOT NULL THEN 6 ELSE 7 END AS br FROM r5),
resolved AS (
 SELECT location, remote,
  CASE br WHEN 1 THEN lat1 WHEN 2 THEN lat2 WHEN 3 THEN lat3 WHEN 4 THEN lat4 WHEN 5 THEN lat5 WHEN 6 THEN lat6 END AS lat,
  CASE br WHEN 1 THEN lng1 WHEN 2 THEN lng2 WHEN 3 THEN lng3 WHEN 4 THEN lng4 WHEN 5 THEN lng5 WHEN 6 THEN lng6 END AS lng,
  CASE WHEN remote THEN country0
   WHEN city IS NULL OR city = '' THEN coalesce(country0, {country_from_freetext('location')})
   WHEN br IN (1, 2) THEN country WHEN br = 3 THEN coalesce(country, known) WHEN br IN (4, 5) THEN fc
   WHEN br = 6 THEN coalesce(country, known)
   ELSE coalesce(country, known, {country_from_address('location')}, {country_from_freetext('location')}) END AS country
 FROM r6)"""


def geo_postings_cte() -> str:
    L = len(fx.LOCATION_STRINGS)
    loc = _case("k", [(i, s) for i, s in enumerate(fx.LOCATION_STRINGS) if s is not None])
    nation = "array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"""gp0 AS (SELECT o.o_orderkey, (o.o_orderkey + c.c_nationkey) % {L + 2} AS k, n.n_name
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
gp AS (SELECT o_orderkey AS job_id,
  CASE WHEN k = {L} THEN {nation} WHEN k = {L + 1} THEN 'Remote, ' || {nation} ELSE {loc} END AS location,
  CASE WHEN o_orderkey % 3 = 0 THEN 'US' END AS country FROM gp0)"""
