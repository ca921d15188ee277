import itertools
import os
import random

import numpy as np
import pytest

from hirelens.llm import language_spans as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(0)
    n = np.array([5, 1, 4])
    score = rng.normal(size=(10, 3)) * 3
    got = L.viterbi(score, L.run_starts(n), n, 2.0)
    for a, k in zip(L.run_starts(n), n):
        value = lambda p: sum(score[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=int(k)), key=value)
        assert value(tuple(got[a:a + k])) == pytest.approx(value(best))


def test_words_and_trigram_places():
    bucket, start, end, script, text, places = L.words(["Ab c", "", "Ωx 1", "漢"])
    assert list(zip(start, end)) == [(0, 2), (3, 4), (6, 8), (11, 12)]
    assert list(text) == [0, 0, 2, 3] and list(places) == [0, 5, 6, 11]
    assert [L.NAMES[s] for s in script] == ["Latin", "Latin", "Greek", "Han"]
    other = L.words(["zz c"])[0]
    assert bucket[3] == other[3] and bucket[4] == other[4]  # a word's trigrams don't reach into the one before


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    word = {"aa": "abc", "bb": "cde", "ru": "бвг"}
    make = lambda lang, n: " ".join("".join(rng.choice(word[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, make(lang := rng.choice(list(word)), 40), lang, "s", 0) for i in range(300)]
    rows += [(1000, make("aa", 30) + ". " + make("ru", 30) + "! " + make("bb", 50), None, None, None), (1001, None, "aa", None, None),
             (1002, "12 3 !", None, None, None), (1003, "漢字", None, None, None), (None, make("ru", 3), None, None, None), (1004, make("aa", 60_000), None, None, 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("lang_pred", L.F.lit("clash")), rows


def test_labels_spans_and_edge_cases(mixed):
    docs, rows = mixed
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(got) == len(rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in rows[:300]) >= 297
    m = got[1000]
    assert [s.lang for s in m.spans] == ["aa", "ru", "bb"] and m.lang_pred == "bb" and 0 < m.score < 1
    text = rows[300][1]
    assert set(text[m.spans[1].start:m.spans[1].end]) <= set("бвг ")
    for i in (1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, [])
    assert got[1003].lang_pred in ("aa", "bb", "ru") and got[None].lang_pred == "ru" and got[1004].lang_pred == "aa"


def test_lang_of_held_out_rows_is_never_read(mixed):
    docs, _ = mixed
    spoilt = docs.withColumn("lang", L.F.when(~L.held_out(), L.F.col("lang")).otherwise("zz"))
    want = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs).collect()}
    assert {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spoilt).collect()} == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty).count() == 0
    one = spark.createDataFrame([(1, "text", None, None, None)], SCHEMA)
    assert L.identify(one).first().lang_pred == "und"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
