import math
import random
from collections import Counter, defaultdict

import pytest

from hirelens.llm import kneser_ney as K

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def plain_model(texts, order):
    """Textbook interpolated modified Kneser-Ney over strings."""
    counts = {order: Counter()}
    for t in texts:
        s = chr(K.START) * (order - 1) + t
        counts[order].update(s[i:i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc = {}
    for n, c in counts.items():
        k = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        disc[n] = [0] + [min(max(i + 1 - (i + 2) * y * k[i + 1] / k[i], 0.1), i + 0.9) for i in range(3)]
    total, off = defaultdict(float), defaultdict(float)
    for n, c in counts.items():
        for g, v in c.items():
            total[n, g[:-1]] += v
            off[n, g[:-1]] += disc[n][min(v, 3)]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / K.SYMBOLS
        low = p(g[1:])
        if (n, g[:-1]) not in total:
            return low
        v = counts[n].get(g, 0)
        return ((v - disc[n][min(v, 3)]) + off[n, g[:-1]] * low) / total[n, g[:-1]]

    return p


def plain_nll(p, text, order):
    s = chr(K.START) * (order - 1) + text
    return -sum(math.log(p(s[i:i + order])) for i in range(len(text)))


def prose(rng, n, alphabet="abcdefghij é"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    train = [prose(rng, rng.choice([1, 3, 40, 300])) for _ in range(30)] + ["漢字 Ωmega\n tab\t", "a"]
    test = [prose(rng, 50), "", None, "zzz!!", "漢字漢", train[0], "aaaa aaaa" * 50]
    return train, test


def test_perplexity_matches_textbook(spark, corpus):
    train, test = corpus
    docs = spark.createDataFrame([(i, t, "x", None, 0) for i, t in enumerate(train)], SCHEMA)
    model = K.train(docs)
    ask = spark.createDataFrame([(i, t, "x", None, 0) for i, t in enumerate(test)], SCHEMA)
    # symbols fold to classes, so the plain model sees the folded text too
    fold = lambda t: "".join(chr(c if c < K.PLAIN else K.PLAIN + c % K.PLAIN) for c in map(ord, t or ""))
    p = plain_model([fold(t) for t in train], K.ORDER)
    for got in (K.score(ask, model), K.score(ask, model, most=3)):  # broadcast and sharded
        rows = {r.doc_id: r for r in got.collect()}
        assert len(rows) == len(test)
        for i, t in enumerate(test):
            assert rows[i]["__n"] == len(t or "")
            assert rows[i]["__nll"] == pytest.approx(plain_nll(p, fold(t), K.ORDER), rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one(spark, corpus):
    p = plain_model(corpus[0], 3)
    seen = {c for t in corpus[0] for c in t}
    for ctx in ("ab", "zz", "é "):
        assert sum(p(ctx + c) for c in seen) + (K.SYMBOLS - len(seen)) * p(ctx + "\x00") == pytest.approx(1)


def test_rejects_junk_by_language_quantile(spark):
    rng = random.Random(2)
    langs = {"x": "abcdefg ", "y": "mnopqrs "}
    rows, labels = [], []
    for i in range(900):
        lang = rng.choice(["x", "y"])
        junk = i % 9 == 0
        rows.append((i, prose(rng, 300, "!$%&#" if junk else langs[lang]), lang, "s", 0))
        if i % 2 == 0:
            labels.append((i, int(not junk), 0))
    rows += [(2000, "", "x", "s", 0), (2001, None, None, None, None), (None, prose(rng, 300, langs["x"]), "x", "s", 0),
             (2002, prose(rng, 300, langs["y"]), None, None, None)]
    labels += [(None, 1, 0), (3, None, None), (5, 1, 0), (5, 0, 0)]
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in K.classify(docs, lab).collect()}
    assert len(got) == len(rows)
    assert not any(got[i].keep for i in range(0, 900, 9))
    assert sum(got[i].keep for i in range(900) if i % 9) >= 0.97 * 800
    assert not got[2000].keep and not got[2001].keep and got[2000].perplexity is None
    assert got[None].keep and got[2002].keep
    kept = K.keep_good(docs.withColumn("keep", docs.doc_id), lab)
    assert kept.columns == [*docs.columns, "keep"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", "x", "s", 0), (2, "", "x", "s", 0)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert {r.doc_id: r.keep for r in K.classify(docs, none).collect()} == {1: True, 2: False}
    assert K.classify(docs.limit(0), none).count() == 0
