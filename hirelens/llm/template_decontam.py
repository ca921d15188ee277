"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Text becomes a sequence of words and numbers. Numbers, units and names (capitalised words unless
all their letters are capitals, and whatever begins a sentence) become typed placeholders, so a question whose numbers, units
and names were exchanged keeps its template. Windows of ``WINDOW`` template words are hashed and
hash-joined between benchmark and documents. Matches on one alignment (document position
minus item position) are taken together and their slots compared: an item's name or unit should stand
for one and the same document value wherever it occurs, which in chance matches of a template it doesn't.
A slot is odd if its document value is neither the item's own nor that of most places of the item's value;
numbers (equal ones may be unequal anew) and sentence openers are never odd. Unless most slots of an
alignment are consistent, its windows that cover an odd slot are dropped.

A document is contaminated by an item if windows on consistent alignments cover at least ``COVER`` of
the item's windows, or an unbroken run of them on one alignment spans ``RUN`` words, however long the item. Before the join, document windows are tested against a fixed-size bit set of the
benchmark's window hashes, so that only likely matches are shuffled; the join is exact.

* In text all in capitals names can't be told, so there only items (or windows) without names are found.
* Null texts are empty. Items with fewer than ``WINDOW`` words, and windows with fewer than ``LITERALS``
  words that are not placeholders, are too little to tell a passage by and match nothing.
* Repeated benchmark items are reported each; repeated document rows count as one document.
* Null doc_ids are one document; null item_ids are one item. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, mark, materialize, may_hold, text_of

WINDOW = 8  # a power of two
LITERALS = 3
COVER = 0.5
RUN = 16  # words
FILTER_BITS = 1 << 20

# Units of measure, money and time that become the placeholder for units.
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yard", "yards", "mile", "miles",
         "mg", "g", "kg", "gram", "grams", "oz", "ounce", "ounces", "lb", "lbs", "pound", "pounds", "ton", "tons",
         "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "cup", "cups",
         "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours",
         "day", "days", "week", "weeks", "month", "months", "year", "years",
         "$", "€", "£", "%", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent",
         "km/h", "mph", "°"]

# Number words, which become the placeholder for numbers.
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
           "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
           "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen"]

#: A word, number or sign; the end of the sentence before it comes along.
TOKEN = r"(?:[.!?]\s+)?(?:\p{L}[\p{L}\p{M}'/]*|\p{N}+(?:[.,]\p{N}+)*|[$€£%°])"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_start(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(".", "!", "?")


def value(token: Column) -> Column:
    """The word itself, lower-cased."""
    return F.lower(F.when(is_start(token), F.regexp_replace(token, r"^[.!?]\s+", "")).otherwise(token))


def template(token: Column, at: Column) -> Column:
    """The word, or # for a number, ~ for a unit, @ for a name or the beginning of a sentence.

    A word in small letters, as most are, is told first and by few comparisons (signs, digits and sentence openers come
    before ``A`` in byte order); nothing is lower-cased but once for it."""
    first = F.substring(token, 1, 1)
    small = (F.when(at == 0, "@")
             .when(token.isin(NUMBERS + UNITS), F.when(token.isin(NUMBERS), "#").otherwise("~"))
             .when((token >= "\u0080") & token.rlike(r"^\p{N}"), "#")
             .otherwise(token))
    other = (F.when((at == 0) | is_start(token), "@")
             .when(first.between("0", "9") | F.lower(token).isin(NUMBERS), "#")
             .when(F.lower(token).isin(UNITS), "~")
             .when((first != F.lower(first)) & (token != F.upper(token)), "@")
             .when(token.rlike(r"^\p{N}"), "#")
             .otherwise(F.lower(token)))
    return F.when((token >= "A") & (F.lower(token) == token), small).otherwise(other)


def halves(array: str, half: int, both: Callable[[Column, Column], Column]) -> Column:
    """``both`` of each element and the one ``half`` places later."""
    n = F.greatest(F.size(array) - half, F.lit(0))
    return F.zip_with(F.slice(F.col(array), F.lit(1), n), F.slice(F.col(array), F.lit(half + 1), n), both)


def windows(rows: DataFrame) -> DataFrame:
    """rows(..., text) -> + words (array), hashes (array: a hash for each window).

    Hashes of runs of 1, 2, 4 and 8 words are built from two of half the length."""
    rows = rows.withColumn("words", tokens(text_of("text"))).drop("text")
    rows = rows.withColumn("hashes", F.transform("words", lambda w, i: F.xxhash64(template(w, i))))
    half = 1
    while half < WINDOW:
        rows = rows.withColumn("hashes", halves("hashes", half, lambda a, b: F.xxhash64(a, b)))
        half *= 2
    return rows


def told_windows(rows: DataFrame) -> DataFrame:
    """``windows`` with null for the hash of a window of too few words that are not placeholders. Only items
    need it: a document's window that meets one of theirs has the same template."""
    literal = F.transform("words", lambda w, i: F.when(template(w, i).isin("@", "#", "~"), 0).otherwise(1))
    rows = windows(rows).withColumn("literals", literal)
    half = 1
    while half < WINDOW:
        rows = rows.withColumn("literals", halves("literals", half, lambda a, b: a + b))
        half *= 2
    told = F.zip_with("hashes", "literals", lambda h, k: F.when(k >= LITERALS, h))
    return rows.withColumn("hashes", told).drop("literals")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item (its row), windows (how many can match), i (position), hash, slots (values)."""
    rows = benchmark.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text")
    told = F.filter(F.transform("hashes", lambda h, i: F.struct(i.alias("i"), h.alias("hash"))), lambda x: x["hash"].isNotNull())
    rows = told_windows(rows).select("item_id", "item", F.size(told).alias("windows"), "words", F.explode(told).alias("x"))
    return rows.select("item_id", "item", "windows", "words", "x.i", "x.hash").withColumn("slots", F.slice("words", F.col("i") + 1, WINDOW)).drop("words")


ALIGNMENT = ["doc_id", "item_id", "item", "shift"]


def odd_alignments(pairs: DataFrame) -> DataFrame:
    """x_doc_id, x_item_id, x_item, x_shift: alignments in which an item's value stands for two document values anywhere."""
    # values of the item against those of the document, over all placeholders of an alignment
    slot = F.filter(F.arrays_zip(F.transform("slots", lambda w, k: F.struct(value(w).alias("v"), template(w, F.col("i") + k).alias("t"))).alias("s"),
                                 F.transform("own", value).alias("o")), lambda x: x["s"]["t"].isin("@", "#", "~"))
    values = pairs.select(*ALIGNMENT, F.explode(slot).alias("x")).select(*ALIGNMENT, F.col("x.s").alias("s"), F.col("x.o").alias("o"))
    return (values.groupBy(*ALIGNMENT, "s").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a <> b")
            .select(*(F.col(c).alias("x_" + c) for c in ALIGNMENT)).distinct())


def odd_slots(pairs: DataFrame) -> DataFrame:
    """x_doc_id, x_item_id, x_item, x_shift, odd (item positions): the odd slots of alignments of which not most slots are consistent."""
    slot = F.filter(F.transform("slots", lambda w, k: F.struct((F.col("i") + k).alias("at"), value(w).alias("v"), template(w, F.col("i") + k).alias("t"),
                                                               value(F.get("own", k)).alias("o"), is_start(w).alias("opens"))),
                    lambda x: x["t"].isin("@", "~") & ~x["opens"] & (x["at"] > 0))
    values = pairs.select(*ALIGNMENT, F.explode(slot).alias("x")).select(*ALIGNMENT, "x.v", "x.t", "x.at", "x.o")
    # an array holds the places of one value in one item
    places = values.groupBy(*ALIGNMENT, "v", "t").agg(F.collect_set(F.struct("at", "o")).alias("xs"))
    odd = F.filter("xs", lambda x: (x["o"] != F.col("v")) & (F.size(F.filter("xs", lambda y: y["o"] == x["o"])) * 2 <= F.size("xs")))
    judged = places.select(*ALIGNMENT, F.size("xs").alias("slots"), F.transform(odd, lambda x: x["at"]).alias("odd"))
    judged = judged.groupBy(*ALIGNMENT).agg(F.sum("slots").alias("slots"), F.flatten(F.collect_list("odd")).alias("odd"))
    return judged.where((F.size("odd") > 0) & (F.size("odd") * 2 >= F.col("slots"))).select(*(F.col(c).alias("x_" + c) for c in ALIGNMENT), "odd")


def longest_run(at: Column) -> Column:
    """Words of the longest run that windows at the sorted positions span without a gap."""
    start = F.struct(F.lit(-WINDOW - 1).alias("last"), F.lit(0).alias("from"), F.lit(0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        begin = F.when(i > acc["last"] + WINDOW, i).otherwise(acc["from"])
        return F.struct(i.alias("last"), begin.alias("from"), F.greatest(acc["best"], i + WINDOW - begin).alias("best"))

    return F.aggregate(at, start, step, lambda acc: acc["best"])


def matches(docs: DataFrame, benchmark: DataFrame, veto: bool = True) -> DataFrame:
    """doc_id, item_id, item, windows (of the item), matched (its windows met on consistent alignments), run (words of
    the longest unbroken run of these on one alignment), first, last (word positions).

    ``veto``: one value that stands for two drops its whole alignment, numbers and sentence openers included. Without it,
    windows that cover odd slots are dropped, as above; that finds all that the veto lets through, and more."""
    items = materialize(item_windows(benchmark), "items")
    likely = bit_filter(items.select("hash"), FILTER_BITS)
    place = lambda h, p: F.when(may_hold(likely, h, FILTER_BITS), F.struct(h.alias("hash"), p.alias("p")))
    found = F.filter(F.transform("hashes", place), lambda x: x.isNotNull())
    # exploding the expression, not a column of it: for a column Spark would infer a filter and compute it twice
    rows = windows(docs.select("doc_id", "text")).select("doc_id", "words", F.explode(found).alias("f"))
    rows = rows.select("doc_id", F.col("f.hash").alias("hash"), F.col("f.p").alias("p"), F.slice("words", F.col("f.p") + 1, WINDOW).alias("own"))
    pairs = rows.join(items, "hash").select("doc_id", "item_id", "item", "windows", "i", "p", F.expr("p - i").alias("shift"), "slots", "own")
    pairs = materialize(pairs, "matches")
    aligned = pairs.select(*ALIGNMENT, "windows", "i", "p")
    same = F.lit(True)
    for c in ALIGNMENT:
        same = same & F.col(c).eqNullSafe(F.col("x_" + c))
    if veto:
        consistent = aligned.join(odd_alignments(pairs), same, "left_anti")
    else:
        covered = F.exists("odd", lambda q: (q >= F.col("i")) & (q < F.col("i") + WINDOW))
        consistent = aligned.join(odd_slots(pairs), same, "left").where(~F.coalesce(covered, F.lit(False)))
    # an array holds positions in one item
    runs = consistent.groupBy(*ALIGNMENT, "windows").agg(F.array_sort(F.collect_set("i")).alias("at"))
    runs = runs.select("doc_id", "item_id", "item", "windows", "shift", longest_run(F.col("at")).alias("run"), F.explode("at").alias("i"))
    return runs.groupBy("doc_id", "item_id", "item", "windows").agg(
        F.count_distinct("i").alias("matched"), F.max("run").alias("run"),
        F.min(F.col("i") + F.col("shift")).alias("first"), F.max(F.col("i") + F.col("shift") + WINDOW).alias("last"))


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, veto: bool = True, run: int = 0) -> DataFrame:
    """One row for each document and benchmark item found in it, by coverage or by a run of ``run`` words (0: by coverage alone):
    doc_id, item_id, windows (of the item), matched, coverage, first_word, end_word."""
    found = matches(docs, benchmark, veto).withColumn("coverage", F.col("matched") / F.col("windows"))
    long_run = F.lit(run > 0) & (F.col("run") >= run)
    return found.where((F.col("coverage") >= cover) | long_run).select(
        "doc_id", "item_id", F.col("windows").cast("long").alias("windows"), "matched", "coverage",
        F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("end_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The documents in which no benchmark item was found, as they came. Only texts that a bit filter
    of the contaminated ids does not clear are shuffled to the exact join."""
    bad = materialize(contaminated(docs, benchmark, cover, veto=False, run=RUN).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    rows = mark(docs, "doc_id", bad, "__suspect")
    cleared = rows.where("__suspect").join(bad, F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")
    return rows.where("not __suspect").unionByName(cleared).select(*docs.columns)
