"""Fuzzy word search over a stored vocabulary: edit distances are asked of distinct words that share enough
letter pairs with the term, never of rows.

Meaning as ``functions.text.fuzzy_match``: a text matches if it contains the term, or if one of its words (between
``\\W+``, lower-cased) is as similar as the threshold, 1 - distance / longer length. Two words at distance k share at
least ``longer - 1 - 2k`` letter pairs (repeats counted); lengths where that says nothing are verified one by one.

Null and empty texts have no words; an empty term is no filter; repeated rows stay; empty tables give empty results.
A text is known by its MD5, so very long ones cost an index row of fixed size a word.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_of
from ..session import materialize


@dataclass(frozen=True)
class WordIndex:
    words: DataFrame  # word, length: distinct words
    pairs: DataFrame  # pair (two letters and which of its repeats), word, length; in order of pair
    texts: DataFrame  # word, key: distinct words of distinct texts


def _lower(c) -> Column:
    return F.lower(F.coalesce(col_of(c), F.lit("")))


def text_words(df: DataFrame, col: str) -> DataFrame:
    """key, word: the distinct words of the distinct texts of a column. A text is hashed once, before its words become rows."""
    texts = df.select(_lower(col).alias("text")).distinct()
    texts = texts.select(F.md5("text").alias("key"), F.array_distinct(F.split("text", r"\W+")).alias("words"))
    return texts.select("key", F.explode("words").alias("word")).where("word <> ''")


def build(df: DataFrame, col: str) -> WordIndex:
    """Index of the distinct texts of a column. Text words are made distinct before anything is shuffled by word."""
    texts = materialize(text_words(df, col), "text-words")
    words = materialize(texts.select("word").distinct().withColumn("length", F.length("word")), "words")
    two = F.transform(F.sequence(F.lit(1), F.col("length") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2)))
    pairs = words.where("length > 1").withColumn("two", two)
    nth = F.transform("two", lambda p, i: F.concat(p, F.size(F.filter(F.slice("two", F.lit(1), i), lambda q: q == p)).cast("string")))
    pairs = pairs.select(F.explode(nth).alias("pair"), "word", "length")
    # the word is part of the range, so that a frequent pair is dealt over partitions
    pairs = materialize(pairs.repartitionByRange("pair", "word").sortWithinPartitions("pair"), "word-pairs")
    return WordIndex(words, pairs, texts)


def allowed(n: int, threshold: float) -> dict[int, int]:
    """Length of a word -> largest distance from a term of ``n`` letters that the threshold lets pass."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    out = {}
    for length in range(1, int(n / threshold) + 2):
        longer = max(n, length)
        k = max(d for d in range(longer + 1) if 1.0 - d / longer >= threshold)
        if abs(length - n) <= k:
            out[length] = k
    return out


def candidates(index: WordIndex, term: str, threshold: float) -> DataFrame:
    """word, length: every word that can be as near as the threshold asks, and few others."""
    term = term.lower()
    n, most = len(term), allowed(len(term), threshold)
    need = {length: max(n, length) - 1 - 2 * k for length, k in most.items()}
    loose = [length for length, shared in need.items() if shared <= 0]
    tight = {length: shared for length, shared in need.items() if shared > 0}
    found = index.words.where(F.col("length").isin(loose))
    if tight:
        seen, own = Counter(), []
        for i in range(n - 1):
            two = term[i:i + 2]
            own.append(f"{two}{seen[two]}")
            seen[two] += 1
        shared = index.pairs.where(F.col("pair").isin(own) & F.col("length").isin(list(tight)))
        shared = shared.groupBy("word", "length").agg(F.count("*").alias("shared"))
        enough = F.lit(False)
        for length, least in tight.items():
            enough = enough | ((F.col("length") == length) & (F.col("shared") >= least))
        found = found.unionByName(shared.where(enough).drop("shared"))
    return found


def close_words(index: WordIndex, term: str, threshold: float = 0.75) -> DataFrame:
    """word, distance: the words as similar to the term as the threshold asks, by a bounded edit distance."""
    most = allowed(len(term), threshold)
    distance = F.lit(-1)
    for k in sorted(set(most.values())):
        lengths = [length for length, most_k in most.items() if most_k == k]
        distance = F.when(F.col("length").isin(lengths), F.levenshtein("word", F.lit(term.lower()), k)).otherwise(distance)
    return candidates(index, term, threshold).select("word", distance.cast("long").alias("distance")).where("distance >= 0")


def fuzzy_filter(df: DataFrame, col: str, index: WordIndex, term: str, threshold: float = 0.75) -> DataFrame:
    """The rows of ``df`` whose text matches the term; ``index`` holds the column's texts (or more)."""
    term = (term or "").lower()
    if not term:
        return df
    hits = index.texts.join(close_words(index, term, threshold), "word", "left_semi").select(F.col("key").alias("__hit")).distinct()
    rows = df.withColumn("__key", F.md5(_lower(col)))
    rows = rows.join(hits, F.col("__key") == F.col("__hit"), "left")
    return rows.where(_lower(col).contains(term) | F.col("__hit").isNotNull()).drop("__key", "__hit")
