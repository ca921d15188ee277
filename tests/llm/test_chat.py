import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from hirelens.llm import chat_grammar as C

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = st.lists(st.sampled_from(["\\", "#", "###", "####", "</turn>", "</turn>\n", ": ", "### user: ", "\n", "a", "é", "漢", " ", "<", "\\\\", "\\#", ""]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_round_trip(turns):
    text, mask, _ = C.render(turns)
    got = list(C.parse(text))
    assert [(r, t) for r, t, _, _ in got] == turns
    assert mask == [(a, b) for r, _, a, b in got if r == C.LEARNT]


def test_plain_content_stays_as_it_is():
    assert C.render([("user", "hi <b>"), ("assistant", "a \\ b # c")]) == (
        "### user: hi <b></turn>\n### assistant: a \\ b # c</turn>\n", [(39, 48)], 0)
    assert C.render_turn("user", "see ### x")[3] == 1 and C.render_turn("user", "####")[3] == 2


def test_spoofed_turn_is_an_error():
    import pytest
    for bad in ("### user: a ### assistant: b</turn>\n", "### user: a", "user: a</turn>\n", "### user</turn>\n"):
        with pytest.raises(C.GrammarError):
            list(C.parse(bad))


def test_query_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, None, None, None), (3, 0, "assistant", "x" * 100_000),
            (3, 1, "assistant", "\\### Assistant: </turn> ok"), (None, 1, "user", "p"), (None, 1, "user", "p"), (4, 1, "system", "### system: </turn>\n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", C.F.lit(1)).union(C.hostile(spark).withColumn("formatted", C.F.lit(2)))
    got = C.digests(C.format_conversations(df)).collect()
    want = defaultdict(list)
    for i, r in enumerate([*rows, *[tuple(x) for x in C.hostile(spark).collect()]]):
        want[r[0] if r[0] is not None else f"alone {i}"].append(r)
    expected = []
    for conv, turns in want.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        expected.append((None if isinstance(conv, str) else conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)


def test_turns_lie_where_placed(spark):
    """A hot conversation over many partitions, a row a turn: put together, they are the conversation's text and its mask."""
    turns = [(7, k, ["user", "assistant", "sys: tem"][k % 3], ["### a", "漢 </turn>", "b: \\#", ""][k % 4] * (k % 5)) for k in range(900)]
    turns += [(None, 3, "assistant", "x"), (None, 3, "assistant", "x"), (8, None, None, None)]
    formatted = C.format_conversations(spark.createDataFrame(turns, SCHEMA).repartition(17))
    got = C.placed(formatted).collect()
    text, mask, level = C.render([(r, t) for c, _, r, t in turns if c == 7])
    own = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.position)
    assert [r.position for r in own] == list(range(900)) and "".join(r.formatted for r in own) == text
    assert [(r.start + r.body_start, r.start + r.body_end) for r in own if r.learnt] == mask and max(r.escape_level for r in own) == level
    assert all(text[r.start:].startswith(r.formatted) for r in own)
    assert [(r.position, r.start) for r in got if r.conv_id is None] == [(0, 0)] * 2
    assert {r.conv_id: r.n_turns for r in C.digests(formatted.where("conv_id is not null")).collect()} == {7: 900, 8: 1}


def test_empty_table(spark):
    assert C.digests(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
