"""Chat windows: exact round trips and the rules of the budget."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import chat as C


@given(st.lists(st.integers(1, 40), max_size=30), st.integers(0, 20), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_windows_cover_each_turn_once(lengths, head, history):
    room = 50 - head
    new = []
    for w in C.windows(lengths, head, 50, history):
        if w.part:
            new.append((w.first, w.part))
            assert lengths[w.first] > room and w.part[1] - w.part[0] <= room
            continue
        assert w.history <= w.first < w.end
        assert sum(lengths[w.history : w.end]) <= room and sum(lengths[w.history : w.first]) <= history
        assert w.end == len(lengths) or sum(lengths[w.history : w.end + 1]) > room  # as many as fit
        grown = w.history and sum(lengths[w.history - 1 : w.first]) <= history and sum(lengths[w.history - 1 : w.first + 1]) <= room
        assert not grown or lengths[w.first] > room  # as much history as allowed
        new += [(t, None) for t in range(w.first, w.end)]
    turns = [t for t, p in new if p is None or p[0] == 0]
    assert turns == list(range(len(lengths)))
    for t in range(len(lengths)):
        parts = [p for u, p in new if u == t and p]
        assert not parts or [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[-1][1] == lengths[t]


def brute(turns, enc):
    """Tokens of the assistant's turns, in order."""
    order = sorted(turns, key=lambda r: (r.turn is None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.text or ""))
    return [i for r in order if r.role == C.TARGET for i in enc.encode_ordinary(C.render(r.role, r.text))]


def targets(windows):
    return [i for w in sorted(windows, key=lambda w: w.window) for s, n in zip(w.target_starts, w.target_lengths) for i in w.input_ids[s : s + n]]


def test_whole_query_is_a_round_trip(spark, sf):
    enc = C.encoder()
    turns, got = {}, {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for w in C.query(spark, sf).collect():
        got.setdefault(w.conv_id, []).append(w)
    assert turns.keys() == got.keys()
    for c in turns:
        assert targets(got[c]) == brute(turns[c], enc)
        order = sorted(turns[c], key=lambda r: r.turn)
        system = enc.encode_ordinary(C.render(order[0].role, order[0].text)) if order[0].role == C.SYSTEM else []
        keep = system and len(system) <= C.BUDGET - C.BUDGET // C.ROOM
        for w in got[c]:
            assert len(w.input_ids) <= C.BUDGET
            assert not keep or w.input_ids[: len(system)] == system
            body = [i for r in order[w.history_turn : w.end_turn] for i in enc.encode_ordinary(C.render(r.role, r.text))]
            assert w.input_ids[len(system) if keep else 0 :] == body or len(body) > C.BUDGET - len(system)


def test_cases(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi " * 30), (1, 2, "assistant", "yes " * 400), (1, 3, "user", None), (1, None, "assistant", "last"), (1, None, "assistant", "last"),
        (2, 0, "system", "only this"), (3, 0, None, "who"), (3, 1, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "system", "long " * 100), (4, 1, "assistant", "ok"),
    ]
    rows += [(5, i, ("user", "assistant")[i % 2], "word " * 12) for i in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("turns", "window", "n", "input_ids"):
        df = df.withColumn(c, F.lit("mine"))
    enc, got, turns = C.encoder(), {}, {}
    for w in C.format_chats(df, 100, 40).collect():
        got.setdefault(w.conv_id, []).append(w)
    for r in df.collect():
        turns.setdefault(r.conv_id, []).append(r)
    assert set(got) == {1, 2, 3, 4, 5, None}
    alone, whose = got.pop(None), turns.pop(None)  # each row of a null conv_id for itself
    assert sorted(w.input_ids for w in alone) == sorted(enc.encode_ordinary(C.render(r.role, r.text)) for r in whose)
    for c in got:
        assert targets(got[c]) == brute(turns[c], enc) and all(len(w.input_ids) <= 100 for w in got[c])
    assert len(got[2]) == 1 and got[2][0].target_starts == []
    assert any(w.history_turn < w.first_turn for w in got[5])
    assert C.format_chats(df.limit(0)).count() == 0


def test_a_long_system_turn_heads_every_window(spark):
    enc, rows = C.encoder(), []
    for conv, words in ((1, 60), (2, 80), (3, 200)):
        rows += [(conv, 0, C.SYSTEM, "long " * words)] + [(conv, i, ("user", C.TARGET)[i % 2], "word " * 12) for i in range(1, 7)]
    rows.append((4, 0, C.SYSTEM, "long " * 200))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns, got = {}, {}
    for r in df.collect():
        turns.setdefault(r.conv_id, []).append(r)
    for w in C.format_chats(df, 100, 40).collect():
        got.setdefault(w.conv_id, []).append(w)
    assert set(got) == {1, 2, 3, 4}
    for c, ws in got.items():
        system = enc.encode_ordinary(C.render(turns[c][0].role, turns[c][0].text))
        head = system[: 100 - 100 // C.ROOM]
        assert targets(ws) == brute(turns[c], enc) and all(len(w.input_ids) <= 100 for w in ws)
        assert all(w.input_ids[: len(head)] == head for w in ws) and len(system) > 50 and len(ws) > 1
        # What a head can't hold follows once, in full.
        cut = sorted((w for w in ws if w.first_turn == 0), key=lambda w: w.window)
        assert (head == system) == (not cut)
        if cut:
            body = [i for w in cut for i in w.input_ids[len(head) :]]
            assert body[: len(system) - len(head)] == system[len(head) :]
