"""Keyed sinks and stateful streams: restarts, and the rules one row at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lignum.operators import log
from lignum.session import shared_folder
from lignum.streaming import keyed, replay, states
from tests.test_small_cases import LOG


def changes(seed, n=300):
    draw = random.Random(seed)
    rows = [(i, draw.randrange(40), draw.choice(["upsert", "upsert", "remove"]), draw.randrange(4), draw.randrange(9), i) for i in range(1, n)]
    return [r if r[2] == "upsert" else (*r[:3], None, None, r[5]) for r in rows]


@pytest.mark.parametrize("crash", ["before", "data", "manifest"])
def test_sink_goes_on_after_a_crash(spark, crash, monkeypatch):
    """A batch that fails before, between or after its writes gives the same table as one run, also if it is applied twice."""
    rows = changes(1)
    batches = [spark.createDataFrame(rows[i : i + 60], LOG) for i in range(0, 300, 60)]
    folder, real = shared_folder(spark, "keyed"), keyed.KeyedTable._rows
    table = keyed.KeyedTable(spark, folder, 8)
    for k, b in enumerate(batches[:2]):
        table.apply(b, k)
    if crash == "data":  # the state of the touched buckets is written, the manifest isn't
        monkeypatch.setattr(spark, "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(OSError("gone")))
    if crash == "before":
        monkeypatch.setattr(keyed.KeyedTable, "_rows", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    if crash != "manifest":
        with pytest.raises(OSError, match="gone"):
            table.apply(batches[2], 2)
        monkeypatch.undo()
        assert keyed.KeyedTable._rows is real and keyed.KeyedTable(spark, folder, 8).position == 1
    again = keyed.KeyedTable(spark, folder, 8)
    for k, b in enumerate(batches[2:], 2):
        again.apply(b, k)
        again.apply(b, k)
    whole = {tuple(r) for r in log.fold(spark.createDataFrame(rows, LOG)).collect()}
    assert {tuple(r) for r in keyed.KeyedTable(spark, folder, 8).read().collect()} == whole
    assert keyed.KeyedTable(spark, folder, 8).position == 4


def test_sink_writes_only_touched_buckets(spark):
    table = keyed.KeyedTable(spark, buckets=16)
    table.apply(spark.createDataFrame(changes(2), LOG), 0)
    table.apply(spark.createDataFrame([(1000, 7, "remove", None, None, 0)], LOG), 1)
    fs, at = replay.hadoop(spark, f"{table.folder}/data/1")
    assert len([f for f in fs.listStatus(at) if f.isDirectory()]) == 1
    table.apply(spark.createDataFrame([], LOG), 2)
    assert table.position == 2 and table.read().filter("id = 7").first().op == "remove"
    assert keyed.KeyedTable(spark).read().count() == 0


def test_late_rows_get_numbers_above_all_given_out(spark):
    """A client that resumes from any number it has seen learns every row published after it; a batch that runs again keeps its numbers."""
    out = keyed.Publisher(spark, ["t"])
    given = [[(5, "a"), (1, "b")], [], [(0, "held back"), (9, "c")]]
    seen = []
    for k, rows in enumerate(given):
        for _ in range(2):
            out.apply(spark.createDataFrame(rows, "t long, what string"), k)
        seen.append(sorted((r.issued, r.what) for r in out.read().collect()))
    assert seen[-1] == [(1, "b"), (2, "a"), (3, "held back"), (4, "c")] and seen[0] == seen[1] == seen[-1][:2]
    again = keyed.Publisher(spark, ["t"], out.folder)
    again.apply(spark.createDataFrame([(2, "d")], "t long, what string"), 3)
    assert again.read().filter("issued > 4").count() == 1


def closing(spark, schema, at):
    return spark.createDataFrame([(-1, -1, at + 10**15) + (True, False) * (len(schema.split(",")) > 3)], schema)


def test_throttle(spark):
    """At once; held and replaced; out after quiet; out when the gap is over; closed at once; what passes changes nothing."""
    ms = 1_000_000
    rows = [(1, 1, 0, False, False), (1, 2, 100, False, False), (1, 3, 200, False, False), (1, 4, 600, False, False), (1, 5, 650, False, True), (1, 6, 5000, False, False), (1, 7, 5100, True, False), (2, 8, 50, False, True), (2, 9, 60, False, False)]
    rows += [(3, 20 + k, 250 * k, False, False) for k in range(9)]
    schema = "id long, seq long, at_ns long, closed boolean, passes boolean"
    df = spark.createDataFrame([(i, s, t * ms + 10**15, c, p) for i, s, t, c, p in rows], schema)
    got = states.collected(states.throttled(replay.replayed(df, "at_ns", files=3, closing=closing(spark, schema, 10**15)))).filter("id > 0").collect()
    found = sorted((r.id, r.seq, (r.published_ns - 10**15) // ms, r.held) for r in got)
    assert found[:9] == [(1, 1, 0, False), (1, 3, 500, True), (1, 4, 900, True), (1, 5, 650, False), (1, 6, 5000, False), (1, 7, 5100, False), (2, 8, 50, False), (2, 9, 60, False), (3, 20, 0, False)]
    assert found[9:] == [(3, 24, 1000, True), (3, 28, 2000, True)] or found[9:] == [(3, 23, 1000, True), (3, 27, 2000, True), (3, 28, 2300, True)]


def test_quiet_batches_one_by_one(spark):
    """Batches of random rows against the rule looked at step by step."""
    draw, unit = random.Random(4), 1_000_000
    schema, rows, want = "id long, seq long, at_ns long", [], []
    for i in range(6):
        t = 10**15
        for k in range(60):
            t += draw.choice([0, 1, 1, 2, 3, 5, 9, 40]) * unit
            rows.append((i, 1000 * i + k, t))
        mine, at = [r for r in rows if r[0] == i], 0
        while at < len(mine):
            begun, before = mine[at][2], 0
            for look in states.steps(2, 8, 50):
                fresh = [r for r in mine if begun + before * unit < r[2] <= begun + look * unit]
                before = look
                if look >= 50 or not fresh:
                    break
            held = [r for r in mine[at:] if r[2] <= begun + before * unit]
            want.append((i, begun, begun + before * unit, len(held), held[0][1], held[-1][1]))
            at += len(held)
    df = spark.createDataFrame(rows, schema)
    got = states.collected(states.quiet_batches(replay.replayed(df, "at_ns", "seq", files=4, closing=closing(spark, schema, 10**15)))).filter("id >= 0")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert states.steps(2, 8, 50) == [2, 4, 6, 8, 16, 24, 32, 40, 48, 56]


def test_snapshot_is_bounded(spark):
    tree = spark.createDataFrame([(1, None, "")] + [(i, max(1, i // 3), f"n{i}" * (i % 9)) for i in range(2, 400)] + [(900, 901, "x"), (901, 900, "y")], "id long, parent long, name string")
    chunks = replay.snapshot_chunks(tree, 500)
    assert chunks.count() == 399 and chunks.groupBy("chunk").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] <= 500
    assert chunks.agg(F.max("chunk")).first()[0] > 50
    with pytest.raises(ValueError, match="half the bound"):
        replay.snapshot_chunks(tree, 100)


def test_ops_are_done_once_while_they_are_held(spark):
    """Repeats count within the time and the last ops done; a batch that runs again and another object give the same."""
    folder = shared_folder(spark, "ops")
    batches = [[("a", 0), ("b", 1), ("a", 2), (None, 3), ("c", None)], [("a", 10), ("a", 11), ("b", 12)], [("c", 13), ("d", 14)], [("b", 15), ("d", 16)], []]
    for k, rows in enumerate(batches):
        log = keyed.OpLog(spark, 10, 2, folder)
        for _ in range(2 if k == 1 else 1):
            log.apply(spark.createDataFrame(rows, "op string, done_ns long"), k)
    # a comes again after 11; b is within 10 of its first time only until 11; c and d push b out, d is still held.
    want = [("a", 0, 1), ("b", 1, 2), ("a", 11, 3), ("b", 12, 4), ("c", 13, 5), ("d", 14, 6), ("b", 15, 7)]
    assert sorted(map(tuple, log.read().select("op", "done_ns", "issued").collect()), key=lambda r: r[2]) == want
