"""Exact round trips of chat formatting and the folding of event logs."""

import hashlib
import random

from discloom.llm.chat import as_events, digest, format_chats, read_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_hostile_texts(spark):
    rnd = random.Random(2)
    bits = ["\\", "<|", "|>", "<", "|", "<|end|>", "<|turn|>", "<|text|>", "\n", "é", "😀", "a", "\\<|", "$1", "end|>"]
    text = lambda: "".join(rnd.choices(bits, k=rnd.randrange(9)))
    rows = [(rnd.randrange(20), rnd.randrange(5), rnd.choice(["user", "assistant", "system", "assistant\n", text()]), text()) for _ in range(400)]
    rows += [(None, 1, "assistant", "x"), (21, None, None, None), (21, 0, "assistant", None), (21, 0, "assistant", None)]
    rows += [(22, k, "assistant", "y" * 2000) for k in range(500)]
    formats = format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r[0]: tuple(r)[1:5] for r in digest(formats).collect()}
    assert got == brute(rows)
    for r in formats.collect():
        spoken = [(r.formatted[s.start - 8 : s.start], r.formatted[s.end : s.end + 7]) for s in r.loss_spans]
        assert set(spoken) <= {("<|text|>", "<|end|>")}


def test_events_fold_into_messages(spark):
    log = [
        (1, 1, "user", "hi", "m1", "message"), (1, 2, "assistant", "Hel", "m2", "delta"), (1, 3, None, "lo", "m2", "delta"), (1, 4, "user", "bye", "m3", None),
        (1, 5, "user", "hi!", "m1", "edit"), (1, 6, "assistant", "Good", "m2", "regenerate"), (1, 7, None, " day", "m2", "delta"), (1, 8, None, "", "m4", "message"),
        (1, 9, None, "", "m4", "delete"), (1, 10, "system", "loose", None, "message"), (2, 1, "user", "", "m1", "delta"),
    ]
    frame = spark.createDataFrame(log, SCHEMA + ", mid string, kind string")
    got = {r[0]: [tuple(t) for t in r[1]] for r in format_chats(frame, message="mid", op="kind").select("conv_id", read_turns("formatted")).collect()}
    assert got == {1: [("user", "hi!"), ("assistant", "Good day"), ("user", "bye"), ("system", "loose")], 2: [("user", "")]}


def test_empty(spark):
    assert digest(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_whole_messages_pass_through_the_fold(spark):
    rnd = random.Random(6)
    rows = [(k % 7, rnd.choice([None, 0, 1, 2]), rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "x", "<|end|>\\", "é😀" * 9])) for k in range(120)]
    rows += [rows[0]] * 3 + [(50, 1, "assistant", "long " * 200_000), (None, 1, "assistant", "z")]
    log = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'m' as message", "'delete' as op", "0 as seq", "'f' as formatted")
    folded = digest(format_chats(as_events(log), seq="seq", message="message", op="op"))
    assert {r[0]: tuple(r)[1:5] for r in folded.collect()} == brute(rows)
    assert digest(format_chats(log)).exceptAll(folded).isEmpty()
