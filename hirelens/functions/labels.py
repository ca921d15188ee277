"""Display / label expressions (age labels, freshness level, money, names,
salary text parsing, stable map jitter). All native Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import presets
from .text import col_of

_MICROS_PER_HOUR = 3_600_000_000


def _epoch_micros(value: dt.datetime) -> int:
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return (value - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def hours_since(ts, now: dt.datetime) -> Column:
    """Fractional hours from ``ts`` (TIMESTAMP or NTZ taken as UTC) to ``now``."""
    return (F.lit(_epoch_micros(now)) - F.unix_micros(col_of(ts).cast("timestamp"))) / F.lit(float(_MICROS_PER_HOUR))


def age_label(ts, now: dt.datetime) -> Column:
    """just now / Nh ago / yesterday / Nd ago; NULL when there is no timestamp."""
    h = hours_since(ts, now)
    days = F.floor(h / 24)
    return (F.when(h.isNull(), F.lit(None))
            .when(h < 1, "just now")
            .when(h < 24, F.concat(F.floor(h).cast("string"), F.lit("h ago")))
            .when(days == 1, "yesterday")
            .otherwise(F.concat(days.cast("string"), F.lit("d ago"))))


def posted_label(ts, now: dt.datetime) -> Column:
    """Today / Yesterday / Nd ago (< 30 days) / 'Mon D' (UTC)."""
    days = F.floor(hours_since(ts, now) / 24)
    return (F.when(days.isNull(), F.lit(None))
            .when(days == 0, "Today")
            .when(days == 1, "Yesterday")
            .when(days < 30, F.concat(days.cast("string"), F.lit("d ago")))
            .otherwise(F.date_format(col_of(ts), "MMM d")))


def freshness_level(ts, now: dt.datetime) -> Column:
    """danger beyond 26 h, warning beyond 8 h, else ok."""
    h = hours_since(ts, now)
    return (F.when(h.isNull(), F.lit(None))
            .when(h > presets.FRESH_DANGER_HOURS, "danger")
            .when(h > presets.FRESH_WARNING_HOURS, "warning")
            .otherwise("ok"))


def money_k(n) -> Column:
    """'$175k': thousands rounded half-up."""
    v = col_of(n)
    return F.when(v.isNotNull(), F.concat(F.lit("$"), F.round(v / 1000.0, 0).cast("bigint").cast("string"), F.lit("k")))


def company_display(c) -> Column:
    """Dashes to spaces, then upper-case the first character of every ASCII word
    run (characters after it are left as they are)."""
    s = F.replace(col_of(c), F.lit("-"), F.lit(" "))
    toks = F.regexp_extract_all(s, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    cap = lambda t: F.when(t.rlike("^[A-Za-z0-9_]"),
                           F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))).otherwise(t)
    return F.when(s.isNotNull(), F.array_join(F.transform(toks, cap), ""))


def country_name(code) -> Column:
    """ISO code -> display name; unknown codes are shown as-is."""
    m = F.create_map(*[F.lit(x) for kv in presets.COUNTRY_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(m, col_of(code)), col_of(code))


def _js_float_prefix(s: Column) -> Column:
    """parseFloat: the leading decimal number after whitespace, else NULL."""
    m = F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(m != "", m.cast("double"))


def parse_salary(text) -> Column:
    """'$120k - $150k' / '$55/hr' / '90000' -> struct<min double, max double>;
    k = x1000, '/hr' = x2080 per year, a single value is both ends."""
    s = F.lower(F.trim(F.regexp_replace(col_of(text), r"[$,]", "")))
    hourly = s.contains("/hr")
    head = F.split(s, "/")[0]
    rng = F.split(head, "-")
    lo_raw = F.trim(rng[0])
    hi_raw = F.when(F.size(rng) > 1, F.trim(rng[1])).otherwise(lo_raw)

    def conv(v: Column) -> Column:
        num = _js_float_prefix(v)
        return F.when((v.isNull()) | (v == ""), F.lit(None)).when(v.contains("k"), num * 1000).otherwise(num)

    lo, hi = conv(lo_raw), conv(hi_raw)
    mult = F.when(hourly, F.lit(2080.0)).otherwise(F.lit(1.0))
    # a missing upper bound multiplied like a JS null (becomes 0) only when hourly
    hi_out = F.when(hourly & hi.isNull(), F.lit(0.0)).otherwise(hi * mult)
    return F.when(col_of(text).isNotNull() & (col_of(text) != "") & lo.isNotNull(),
                  F.struct((lo * mult).alias("min"), hi_out.alias("max")))


def js_number_string(x) -> Column:
    """Number -> text the way a browser prints it for integral and ordinary
    fractional values (30.0 -> '30', 30.25 -> '30.25')."""
    v = col_of(x)
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def stable_jitter(key) -> Column:
    """32-bit ``h = 31*h + code`` string hash -> struct(dlat, dlng) in ±0.01°.
    Folded in BIGINT modulo 2^32 (no int overflow under ANSI)."""
    chars = F.split(col_of(key), "")
    h = F.aggregate(chars, F.lit(0).cast("bigint"),
                    lambda acc, ch: F.pmod(acc * 31 + F.ascii(ch).cast("bigint"), F.lit(4294967296)))
    low16 = h.bitwiseAND(F.lit(65535))
    high16 = F.shiftright(h, 16).bitwiseAND(F.lit(65535))
    return F.struct(((low16 / 65535.0 - 0.5) * 0.02).alias("dlat"),
                    ((high16 / 65535.0 - 0.5) * 0.02).alias("dlng"))
