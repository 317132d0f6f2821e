"""Chat formatting against a fold one event at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lignum.llm import chat

SCHEMA = "conv_id long, message long, seq long, part long, kind string, role string, text string"


def folded(events):
    """What each conversation's messages are after all events, one by one: ``{conv: [(role, text)]}``."""
    state = {}
    for conv, message, seq, part, kind, role, text in sorted(events, key=lambda e: (e[0], e[2] is not None, e[2] or 0, e[3])):
        held = state.setdefault(conv, {})
        text, at = text or "", len(held)
        if kind == "begin" and message not in held:
            held[message] = [at, role or "", text, True]
        elif message in held:
            if kind == "delta":
                held[message][2] += text
            elif kind in ("edit", "begin"):
                held[message][2] = text
            elif kind == "regenerate":
                held[message][2] = text
                for other in held.values():
                    other[3] &= other[0] <= held[message][0]
    kept = {c: [(r, t) for _, r, t, there in sorted(held.values()) if there] for c, held in state.items()}
    return {c: m for c, m in kept.items() if m}


def got(spark, events):
    out = chat.formatted(spark.createDataFrame(events, SCHEMA))
    back = chat.read_back(out).collect()
    return out, {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back}, {r.conv_id: list(r.learned) for r in back}


@pytest.mark.parametrize("seed", range(4))
def test_logs_of_all_kinds(spark, seed):
    draw, events = random.Random(seed), []
    pieces = ["", "a", "é\n", "</s>", "[INST]", "[\\INST] \\", "<\\\\s>", "[/ROLE]", "<", "/s>", "😀", None]
    for conv in (1, 2, 3):
        for seq in range(150 if conv == 3 else 25):
            kind = draw.choice(["begin", "begin", "begin", "delta", "delta", "edit", "other"] + ["regenerate"] * (seed > 0))
            events.append((conv, draw.randrange(max(2, seq)), None if seq == 0 else seq * 3, 0, kind, draw.choice(["user", "assistant", "[ROLE]", None]), draw.choice(pieces)))
    draw.shuffle(events)
    want = folded(events)
    out, turns, learned = got(spark, events)
    assert turns == want and len(want) == 3
    assert learned == {c: [t if r == "assistant" else "" for r, t in m] for c, m in want.items()}
    for r in out.collect():
        assert r.n_turns == len(want[r.conv_id]) == len(r.loss_runs)
        assert sum(x.before + x.inside + x.after for x in r.loss_runs) == len(r.formatted)
        at, under = 0, []
        for x in r.loss_runs:
            under.append(r.formatted[at + x.before : at + x.before + x.inside])
            at += x.before + x.inside + x.after
        assert not any("</s>" in u or "[ROLE]" in u for u in under)


def test_turns_as_a_log(spark):
    """Null turns come first, ties go by role, repeated rows count, nulls are empty, long texts come in many deltas, an own column ``seq`` or ``part`` doesn't matter."""
    long = "x[INST]é" * 40_000
    rows = [(1, 2, "assistant", long, 9), (1, None, None, None, 9), (1, 1, "user", "b", 9), (1, 1, "user", "b", 9), (1, 1, "a", "z", 9), (None, 0, "user", "q", 9), (2, 0, "assistant", "", 9)]
    log = chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long").withColumn("part", F.lit("p")))
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.formatted(log)).collect()}
    assert out == {1: [("", ""), ("a", "z"), ("user", "b"), ("user", "b"), ("assistant", long)], None: [("user", "q")], 2: [("assistant", "")]}
    assert log.count() > 150


def test_empty(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_workers(spark, sf):
    assert "Python" not in chat.op13_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
