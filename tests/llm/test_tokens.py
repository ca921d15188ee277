import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from hirelens.llm import token_spans as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def enc():
    return T.Encoder(open(T.VOCABULARY + ".tiktoken", "rb").read(), open(T.VOCABULARY + ".json", encoding="utf-8").read())


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(T.VOCABULARY + ".json")
    t.encode_special_tokens = True
    return t


def plain(start, end, sections, rule):
    """Character by character."""
    counts, crossing, outside = [0.0] * len(sections), [0] * len(sections), 0.0
    for s, e in zip(start, end):
        over = [sum(a <= c < b for c in range(s, e)) for a, b in sections]
        met = [k for k, o in enumerate(over) if o]
        whole = len(met) == 1 and over[met[0]] == e - s
        for k in met:
            crossing[k] += not whole
        if rule == "start":
            hit = [k for k in met if sections[k][0] <= s]
            if hit:
                counts[hit[0]] += 1
            else:
                outside += 1
        elif rule == "most":
            if met:
                counts[max(met, key=lambda k: (over[k], -k))] += 1
            else:
                outside += 1
        else:
            for k in met:
                counts[k] += over[k] / (e - s)
            outside += 1 - sum(over) / (e - s)
    return counts, crossing, outside


TEXTS = ["Hello world,\n\n  two lines\n\n\n end", "Größe 漢字 naïve 😀😀 ok\nline\n", "<|endoftext|> a\n", "x" * 3000 + "\n" + "y", "\n\n\n", " \n \n"]


def test_ids_and_offsets_match_the_other_library(enc, other):
    for t in TEXTS:
        got = other.encode(t, add_special_tokens=False)
        assert enc.encode(t).tolist() == got.ids
        start, end = enc.spans(t)
        if t.isascii():
            assert "".join(t[a:b] for a, b in zip(start, end)) == t
        assert all(a < b for a, b in zip(start, end)) and start[0] == 0 and end[-1] == len(t)


def test_blank_runs_fall_back(enc):
    t = "a" + " " * 300_000 + "b"
    start, end = enc.spans(t)
    assert end[-1] == len(t)


@pytest.mark.parametrize("rule", T.RULES)
def test_attribution_matches_characters(enc, rule):
    rng = random.Random(8)
    for t in TEXTS * 6:
        start, end = enc.spans(t)
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, rng.randrange(0, 8) * 2)))
        sections = list(zip(cuts[::2], cuts[1::2]))
        a, b = (np.array([s[k] for s in sections], np.int64) for k in (0, 1))
        counts, crossing, outside = T.attribute(start, end, a, b, rule)
        want = plain(start, end, sections, rule)
        assert counts.tolist() == pytest.approx(want[0]) and crossing.tolist() == want[1] and outside == pytest.approx(want[2], abs=1e-9)
        assert counts.sum() + outside == pytest.approx(len(start))


def test_lines_of_documents(spark, other):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(50, None, None, None, None), (51, "", None, None, None), (None, "a b", None, None, None), (0, TEXTS[0], None, None, None)]
    got = T.count(spark.createDataFrame(rows, SCHEMA)).collect()
    for i, t in enumerate(TEXTS):
        own = [r for r in got if r.doc_id == i]
        n = len(other.encode(t, add_special_tokens=False).ids)
        assert sum(r.n_tokens for r in own) == n * (2 if i == 0 else 1) and {r.doc_tokens for r in own} == {n}
        assert "".join(t[r.start:r.end] for r in sorted(own, key=lambda r: (r.section, r.start))) == (t if i else "".join(x + x for x in t.splitlines(True)))
    for i in (50, 51):
        assert [(r.section, r.n_tokens, r.doc_tokens) for r in got if r.doc_id == i] == [(None, 0.0, 0)]
    assert sum(r.n_tokens for r in got if r.doc_id is None) == 2
    assert T.count(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "title body text", None, None, None), (2, "no sections", None, None, None)], SCHEMA)
    sections = spark.createDataFrame([(1, "title", 0, 5), (1, "body", 6, 15), (9, "x", 0, 1)], "doc_id long, name string, start long, end long")
    got = {(r.doc_id, r.name): (r.n_tokens, r.n_crossing) for r in T.count(T.with_sections(docs, sections), sections="sections").collect()}
    assert got == {(1, "title"): (1.0, 0), (1, "body"): (2.0, 1), (2, None): (2.0, 0)}


def test_overlapping_sections_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "title body text", "x", 1)], "doc_id long, text string, sections string, start long")
    assert [(r.name, r.n_tokens) for r in T.count(docs).collect()] == [("line 1", 3.0)]  # a column that happens to be called so
    given = [(1, "all", 0, 10), (1, "inside", 2, 5), (1, "late", 4, 15), (1, "backwards", 12, 11), (1, "open", None, 3), (1, None, -3, -1)]
    sections = spark.createDataFrame(given, "doc_id long, name string, start long, end long")
    got = sorted(T.count(T.with_sections(docs, sections), sections="sections").collect(), key=lambda r: r.section)
    assert [(r.name, r.start, r.end, r.n_tokens, r.n_crossing) for r in got] == [
        (None, 0, 0, 0.0, 0), ("all", 0, 10, 2.0, 0), ("inside", 10, 10, 0.0, 0), ("late", 10, 15, 1.0, 0), ("backwards", 15, 15, 0.0, 0)]
    other = T.with_sections(docs, sections.limit(1), "parts")
    assert [(r.name, r.n_tokens) for r in T.count(other, sections="parts").collect()] == [("all", 2.0), (None, 1.0)]
