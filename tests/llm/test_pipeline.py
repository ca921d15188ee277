"""The whole pipeline against a brute-force version of each stage, on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from test_decontam import plain as plain_matches
from test_kneser_ney import plain_model, plain_nll
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from hirelens.llm import apportion, kneser_ney, slots

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "an", "er", "ou", "in", "re"]) for _ in range(rng.randrange(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, prose(24)) for i in range(5)]
    rows = []
    for i in range(260):
        text = prose(rng.randrange(25, 120))
        if i % 11 == 0:
            text = " ".join(rng.choice(["$$$", "%%%", "&&&"]) + w for w in text.split(" "))
        if i % 13 == 5:
            text += " " + items[i % 5][1]
        rows.append((i, text, rng.choice(["x", "y", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
    rows += [(1000 + i, rows[i][1] + (" more" if i % 2 else ""), "x", "a", 0) for i in range(40)]
    rows += [(2000, None, None, None, None), (2001, "", "x", "b", 0), (2002, rows[1][1], None, None, None), (1, *rows[1][1:])]
    labels = [(i, int(i % 11 != 0), 0) for i in range(0, 260, 1) if i % 3]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, labels, items


def plain_quality(rows, labels):
    trusted = {i for i, q, _ in labels if q == 1}
    held = {i for i in trusted if zlib.crc32(str(i).encode()) % kneser_ney.HELD_ONE_IN == 0}
    p = plain_model([r[1] for r in rows if r[0] in trusted - held and r[1]], kneser_ney.ORDER)
    nll = [plain_nll(p, r[1], kneser_ney.ORDER) if r[1] else None for r in rows]
    smooth = lambda x, n, prior: (x + prior * kneser_ney.PRIOR_SYMBOLS) / (n + kneser_ney.PRIOR_SYMBOLS)

    def mean(texts):
        return sum(x for x, _ in texts) / sum(n for _, n in texts)

    def far(texts):
        bins = sorted(math.ceil((smooth(x, n, prior) - prior) / kneser_ney.BIN) for prior, x, n in texts)
        return bins[math.ceil(len(bins) * kneser_ney.QUANTILE) - 1] * kneser_ney.BIN

    own = {}
    for r, x in zip(rows, nll):
        if r[0] in held and x is not None:
            own.setdefault(r[2], []).append((x, len(r[1])))
    apart = {lang: [(mean(v), *t) for t in v] for lang, v in own.items()}
    pooled = far([t for v in apart.values() for t in v])
    middle = mean([t for v in own.values() for t in v])
    whole = middle, middle + pooled
    by = {lang: (mean(own[lang]), mean(own[lang]) + (far(v) * len(v) + pooled * kneser_ney.PRIOR_DOCS) / (len(v) + kneser_ney.PRIOR_DOCS)) for lang, v in apart.items()}
    judge = lambda r, x: (lambda s: smooth(x, len(r[1]), s[0]) <= s[1])(by.get(r[2], whole))
    return [r for r, x in zip(rows, nll) if x is not None and judge(r, x)]


def plain_pipeline(rows, labels, items):
    yield "quality", (rows := plain_quality(rows, labels))
    least = plain_components([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows])
    yield "near_duplicates", (rows := list({r[0]: r for r, c in zip(rows, least) if r[0] == c}.values()))
    bad = {d for d, *_ in plain_matches([r[:2] for r in rows], items)}
    yield "decontaminate", (rows := [r for r in rows if r[0] not in bad])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    taken = {d: (t, n) for d, t, n in con.execute(f"SELECT doc_id, taken, size FROM ({apportion.oracle()})").fetchall()}
    mixed = []
    for r in rows:
        key = hashlib.md5(f"{apportion.SEED}:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
        draw = int(hashlib.md5(f"round:{key}".encode()).hexdigest()[:8], 16) / 2**32
        t, n = taken[r[0]]
        mixed += [r] * math.floor(t / n + draw)
    yield "mix", mixed
    con.execute("DELETE FROM documents")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", mixed)
    yield "shard", con.execute(slots.oracle()).fetchall()


def test_every_stage_matches_brute_force(spark, tables):
    path, rows, labels, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = rows
    for (name, stage), (label, want) in zip(corpus_pipeline.STAGES, plain_pipeline(rows, labels, items), strict=True):
        out = stage(spark, docs, path)
        got = [tuple(r) for r in out.collect()]
        assert name == label and Counter(got) == Counter(want), name
        if name != "shard":
            assert out.columns == docs.columns and 0 < len(got)
            assert name == "mix" or len(got) < len(before)
            docs, before = spark.createDataFrame(got, DOCS), got
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) == Counter(want)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_pass_through(spark, tables):
    path, _, _, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "doc_id AS size", "1 AS virtual_slot", "'k' AS key", "2 AS shard", "3 AS fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.where("key <> 'k' or fp <> 3 or doc_id <> size").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() == docs.count()
