import os
import random
import re

import pytest

from hirelens.llm import template_decontam as D

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
SF = "/root/testdata/sf0.01"


def plain_tokens(text):
    letter = r"[^\W\d_]"
    found = re.findall(rf"(?:[.!?]\s+)?(?:{letter}(?:{letter}|['/])*|\d+(?:[.,]\d+)*|[$€£%°])", text or "")
    out = []
    for i, t in enumerate(found):
        start, low = t[0] in ".!?", re.sub(r"^[.!?]\s+", "", t).lower()
        if i == 0 or start:
            kind = "@"
        elif t[0].isdigit() or low in D.NUMBERS:
            kind = "#"
        elif low in D.UNITS:
            kind = "~"
        elif t[0] != t[0].lower() and t != t.upper():
            kind = "@"
        else:
            kind = low
        out.append((kind, low))
    return out


def plain(docs, items):
    """Every window of every document against every window of every item."""
    rows = set()
    n = D.WINDOW
    cut = lambda t: [t[i:i + n] for i in range(len(t) - n + 1)]
    told = lambda w: sum(k not in "@#~" for k, _ in w) >= D.LITERALS
    for d, text in docs:
        own = {}
        for p, w in enumerate(cut(plain_tokens(text))):
            own.setdefault(tuple(k for k, _ in w), []).append((p, w))
        for item, itext in items:
            windows = [(i, w) for i, w in enumerate(cut(plain_tokens(itext))) if told(w)]
            shifts = {}
            for i, w in windows:
                for p, v in own.get(tuple(k for k, _ in w), []):
                    shifts.setdefault(p - i, []).append((i, w, v))
            hit = set()
            for found in shifts.values():
                values = {}
                for _, w, v in found:
                    for (k, a), (_, b) in zip(w, v):
                        if k in "@#~":
                            values.setdefault((k, a), set()).add(b)
                if all(len(v) == 1 for v in values.values()):
                    hit |= {i for i, _, _ in found}
            if windows and len(hit) / len(windows) >= D.COVER:
                rows.add((d, item, len(windows), len(hit)))
    return rows


def opens(text):
    """Word positions that begin a sentence."""
    letter = r"[^\W\d_]"
    found = re.findall(rf"(?:[.!?]\s+)?(?:{letter}(?:{letter}|['/])*|\d+(?:[.,]\d+)*|[$€£%°])", text or "")
    return {i for i, t in enumerate(found) if i == 0 or t[0] in ".!?"}


def plain_rule(docs, items, cover=D.COVER, run=D.RUN, most=True, numbers=True):
    """The registered rule (odd slots drop windows, runs of words), by loops. ``most`` and ``numbers`` off break a rule on purpose."""
    rows, n = set(), D.WINDOW

    def cut(text):
        t = plain_tokens(text)
        if not numbers:
            t = [(w if w in D.NUMBERS and k == "#" else k, w) for k, w in t]
        return [(i, tuple(k for k, _ in t[i:i + n]), t[i:i + n]) for i in range(len(t) - n + 1)]

    asked = {}
    for item, text in items:
        told = [(i, key, w) for i, key, w in cut(text) if sum(k not in "@#~" for k in key) >= D.LITERALS]
        for i, key, w in told:
            asked.setdefault(key, []).append((item, len(told), opens(text), i, w))
    for d, text in docs:
        shifts = {}
        for p, key, own in cut(text):
            for item, total, first, i, w in asked.get(key, []):
                shifts.setdefault((item, total), {}).setdefault(p - i, []).append((i, w, own, first))
        for (item, total), by_shift in shifts.items():
            hit, longest = set(), 0
            for found in by_shift.values():
                places = {}
                for i, w, own, first in found:
                    for k, ((kind, v), (_, o)) in enumerate(zip(w, own)):
                        if kind in "@~" and i + k not in first:
                            places.setdefault((kind, v), set()).add((i + k, o))
                odd = [at for (_, v), xs in places.items() for at, o in xs if o != v and 2 * sum(y == o for _, y in xs) <= len(xs)]
                slots = sum(map(len, places.values()))
                drop = set(odd) if 2 * len(odd) >= slots or not most else set()
                at = sorted({i for i, *_ in found if not any(i <= q < i + n for q in drop)})
                hit |= set(at)
                for a, i in enumerate(at):
                    if a == 0 or i > at[a - 1] + n:
                        begin = i
                    longest = max(longest, i + n - begin)
            if len(hit) / total >= cover or longest >= run:
                rows.add((d, item, total, len(hit)))
    return rows


def got(df):
    return {(r.doc_id, r.item_id, r.windows, r.matched) for r in df.collect()}


QUESTION = ("Tom has 12 apples and gives 5 kg of them to Anna for 3 dollars. Then Tom sells the other 12 apples, "
            "each for 2 dollars, while Anna keeps her 5 kg. How many dollars does Tom have in the end?")
ANEW = ("Zoe has 40 apples and gives 9 lb of them to Kim for 8 euros. Then Zoe sells the other 40 apples, "
        "each for 6 euros, while Kim keeps her 9 lb. How many euros does Zoe have in the end?")
TORN = ("Zoe has 40 apples and gives 9 lb of them to Kim for 8 euros. Then Bob sells the other 41 apples, "
        "each for 6 cents, while Jim keeps her 7 kg. How many euros does Liz have in the end?")
NAMELESS = "The red train runs from one town to the next in 3 hours. It waits for 10 minutes and goes back at half the speed."


def test_parameters_may_change_but_consistently(spark):
    rows = [(1, "Before. " + QUESTION + " After."), (2, "x y z " + ANEW + " and so on"), (3, TORN), (4, "Clean text about apples, dollars and kg of things to sell for 3 dollars."),
            (5, "LOUD!! " + NAMELESS.upper()), (6, None), (7, ""), (8, ("filler words here " * 20_000) + ANEW), (1, "Before. " + QUESTION + " After."), (None, QUESTION)]
    items = [(10, QUESTION), (10, QUESTION), (11, "too short"), (None, None), (13, NAMELESS), (12, "A b c d e f g h. I j k l m n o p.")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("item_id", D.F.lit("clash"))
    df = D.contaminated(docs, spark.createDataFrame(items, ITEMS))
    found = got(df)
    assert {d for d, *_ in found} == {1, 2, 5, 8, None} and {i for _, i, *_ in found} == {10, 13}
    assert found == plain(rows, items)
    kept = D.drop_contaminated(docs, spark.createDataFrame(items, ITEMS))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 6, 7}


def test_matches_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "Ann", "Bo", "runs", "12", "7.5", "km", "eats", "red", "big", "when", "near", "%", "It"]) + rng.choice([""] * 6 + [",", ".", "!"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(25)]
    rows = []
    for d in range(120):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            own = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(own))
            own = own[a:] if d % 2 else [rng.choice(["Ann", "12", "9", "Cy"]) if w in ("Ann", "12", "Bo") else w for w in own]
            text[len(text) // 2:len(text) // 2] = own
        rows.append((d, " ".join(text)))
    want = plain(rows, items)
    assert len(want) > 10
    assert got(D.contaminated(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS), spark.createDataFrame(items, ITEMS))) == want


SHEEP = ("A farmer keeps 5 sheep in the barn behind the house and also 5 goats on the hill near the river, "
         "so how many animals does the farmer feed each day?")
OPENERS = ("The baker sells bread at the old market. The miller brings flour to the bakery each morning. "
           "The children carry water from the well to the kitchen.")
EDITED = "We know that Carla paints a fence while the neighbour of Carla waters the roses."


def test_one_odd_slot_vetoes_no_copy(spark):
    rows = [(1, SHEEP.replace("5 sheep", "7 sheep").replace("5 goats", "9 goats")), (2, "Its".join(OPENERS.rsplit("The", 1))),
            (3, EDITED.replace("of Carla", "of Berta")), (4, TORN)]
    items = [(20, SHEEP), (21, OPENERS), (22, EDITED), (10, QUESTION)]
    docs, bench = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS), spark.createDataFrame(items, ITEMS)
    found = {(r.doc_id, r.item_id): r.coverage for r in D.contaminated(docs, bench, veto=False).collect()}
    assert found == {(1, 20): 1, (2, 21): 1, (3, 22): 0.5}  # the last without the windows that hold Berta
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {4}


def test_long_passages_and_number_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6))
    words = [word() for _ in range(89)]
    count = "We know that Mia puts three apples and two pears in a basket and sells five of the apples for eight coins."
    rows = [(1, "Before. " + " ".join(words[:35]) + " after"), (2, "Before " + " ".join(words[40:40 + D.RUN - 1]) + " after"),
            (3, count.replace("three", "seven").replace("two", "9").replace("five", "six").replace("eight", "forty")),
            (4, " ".join([*words[:10], word(), *words[11:21], word()]))]  # runs of 10 words only
    items = [(30, " ".join(words)), (31, count)]
    docs, bench = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS), spark.createDataFrame(items, ITEMS)
    found = {(r.doc_id, r.item_id): r.matched for r in D.contaminated(docs, bench, veto=False, run=D.RUN).collect()}
    assert set(found) == {(1, 30), (3, 31)} and found[1, 30] == 28
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {2, 4}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, QUESTION, None, None, None)], DOCS), spark.createDataFrame([(1, QUESTION)], ITEMS)
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.drop_contaminated(docs, items.limit(0)).count() == 1


def test_plan_is_native(spark):
    docs, items = spark.createDataFrame([(1, QUESTION, None, None, None)], DOCS), spark.createDataFrame([(1, QUESTION)], ITEMS)
    plan = D.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_tables_match_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and got(D.contaminated(docs, items)) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_registered_rule_matches_brute_force_on_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_rule([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and got(D.contaminated(docs, items, veto=False, run=D.RUN)) == want


def test_registered_rule_matches_brute_force(spark):
    rng = random.Random(16)
    word = lambda: rng.choice(["the", "of", "Ann", "Bo", "runs", "12", "three", "Seven", "km", "Miles", "eats", "red", "big", "when", "near", "%", "It", "\u00e9t\u00e9", "\u00c9mile"]) + rng.choice([""] * 6 + [",", ".", "!"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 70)))) for i in range(25)]
    swap = {"Ann": "Cy", "Bo": "Di", "12": "9", "three": "two", "km": "lbs"}
    rows = []
    for d in range(160):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if d % 2 == 0:
            own = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(own))
            own = own[a:] if d % 4 else [swap.get(w, w) if d % 8 else rng.choice([w, *swap.values()]) if w in swap else w for w in own]
            text[len(text) // 2:len(text) // 2] = own
        rows.append((d, " ".join(text)))
    want = plain_rule(rows, items)
    docs, bench = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS), spark.createDataFrame(items, ITEMS)
    assert len(want) > 10
    assert got(D.contaminated(docs, bench, veto=False, run=D.RUN)) == want
    broken = [plain_rule(rows, items, run=10 ** 6), plain_rule(rows, items, most=False), plain_rule(rows, items, numbers=False)]
    assert all(b != want for b in broken)  # the rows tell each of the three rules
