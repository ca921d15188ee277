import random

import pytest

from hirelens.functions.text import fuzzy_match
from hirelens.operators import word_index as W


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_close_words_match_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abano") for _ in range(rng.randrange(1, 9))) for _ in range(900)} | {"banana", "bananas", "bnana", "londn"}
    index = W.build(spark.createDataFrame([(" ".join(words),), ("Banana, BANANAS!",)], "t string"), "t")
    for term, threshold in [("banana", 0.75), ("anaab", 0.6), ("ab", 0.5), ("a", 1.0), ("bananabo", 0.8)]:
        want = {(w, distance(w, term)) for w in words if 1.0 - distance(w, term) / max(len(w), len(term)) >= threshold}
        assert {(r.word, r.distance) for r in W.close_words(index, term, threshold).collect()} == want
    in_band = sum(len(w) in W.allowed(6, 0.75) for w in words)
    asked = W.candidates(index, "banana", 0.75).count()
    assert asked * 4 < in_band  # the pairs leave few words to verify


def test_filter_is_the_row_filter(spark):
    rows = [(i, t) for i, t in enumerate(["London, UK", "Londn", "New Londonderry", None, "", "lodnon", "Paris", "LONDO", "x " * 20_000 + "lndon", "Zürich", "Londn"])] * 2
    df = spark.createDataFrame(rows, "id int, t string").selectExpr("*", "'clash' AS word", "'clash' AS key", "1 AS length")
    index = W.build(df, "t")
    for term in ["londn", "London", "zürich", "qqqq", ""]:
        got = W.fuzzy_filter(df, "t", index, term)
        assert got.columns == df.columns
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.where(fuzzy_match("t", term)).collect())
    plan = W.fuzzy_filter(df, "t", index, "londn")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan and "split" not in plan  # distances of stored words, not of words of rows


def test_empty_tables_and_thresholds(spark):
    none = spark.createDataFrame([], "t string")
    index = W.build(none, "t")
    assert W.fuzzy_filter(none, "t", index, "londn").count() == 0
    with pytest.raises(ValueError):
        W.allowed(3, 0)


def test_a_text_is_hashed_once_not_once_a_word(spark):
    df = spark.createDataFrame([("One two one",), ("one TWO one",), ("three",), (None,)], "t string")
    words = W.text_words(df, "t")
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("md5")  # below the step that makes rows of the words
    assert sorted(r.word for r in words.collect()) == ["one", "three", "two"]
