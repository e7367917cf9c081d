import hashlib

from hypothesis import given, settings, strategies as st

from factweave.llm import chat

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN>>", "<</TURN>>", "\\", "<", "[", "/", "\n", "a", "é", "<\\/s>", "[\\INST]"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", "tool", ""]), PIECES), PIECES), max_size=5))
def test_round_trip_and_loss_mask(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_replay_folds_events(spark):
    events = [
        (1, 1, "start", "a", "user", "hel"), (1, 2, "piece", "a", None, "lo"), (1, 3, "start", "b", "assistant", "first"), (1, 4, "start", "c", "user", "gone"),
        (1, 5, "redo", "b", None, "sec"), (1, 6, "piece", None, None, "ond"), (1, 7, "edit", "a", None, "hi"), (1, 8, "piece", "nobody", None, "x"), (1, 9, "start", "d", "tool", None), (1, 10, "drop", "d", None, None),
        (2, 1, "piece", None, None, "no message"), (3, 2, "piece", "z", None, "!"), (3, 1, "start", "z", None, "late"), (None, 1, "start", "n", "user", "x"),
    ]
    frame = spark.createDataFrame([(*e, "k") for e in events], "conv_id long, seq long, kind string, message string, role string, text string, key string").repartition(3)
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.replay(frame, ["seq"]).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "second")], 2: [], 3: [("", "late!")], None: [("user", "x")]}


def test_conversations_by_turn(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (5, 3, "assistant", "x" * 1000), (5, 1, "user", None), (5, 1, "user", None), (5, 2, "assistant", "é😀"), (None, 0, None, "q")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(4)
    got = {r.conv_id: r for r in chat.digests(chat.replay(*chat.turn_events(frame))).collect()}

    def sha(turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert got[-1].turns_sha256 == sha([("user", said), ("assistant", said)]) and got[-1].loss_chars == len(said)
    five = [("user", ""), ("user", ""), ("assistant", "é😀"), ("assistant", "x" * 1000)]
    assert got[5].n_turns == 4 and got[5].turns_sha256 == sha(five)
    assert got[5].loss_chars == 1002 and got[5].loss_sha256 == hashlib.sha256(("é😀" + "x" * 1000).encode()).hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat.digests(chat.replay(*chat.turn_events(frame.limit(0)))).collect() == []
