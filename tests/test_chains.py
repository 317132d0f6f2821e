"""Chains, waiting moves, fates, ranks, clocks, state changes and reports against simple programs."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lignum.operators import chains, clocks, log, ranks, transitions, tree
from lignum.session import shared_folder, stored
from lignum.sources import reports
from tests.test_ranges import ranges  # noqa: F401


def made_in_rounds(moves, places):
    """Moves one round at a time: each round takes those whose place was free before it."""
    held = {place: i for i, place in places.items()}
    todo, out, rounds = {}, {}, 0
    for i, to in sorted(moves.items()):
        if i not in places:
            out[i] = (None, "gone", False)
        elif places[i] == to:
            out[i] = (None, "stays", False)
        else:
            todo[i] = to
    first = {}
    for i, to in sorted(todo.items()):
        first.setdefault(to, i)
    free = {i: to for i, to in todo.items() if first[to] == i}
    while True:
        rounds += 1
        now = [i for i, to in free.items() if to not in held]
        if not now:
            break
        for i in now:
            out[i] = (rounds, "moved", False)
        for i in now:
            del held[places[i]]
        for i in now:
            held[free.pop(i)] = -1
    by_place = {places[i]: i for i in free}
    for i in sorted(free):
        ring, at = [i], by_place.get(free[i])
        while at is not None and at not in ring:
            ring.append(at)
            at = by_place.get(free[at])
        if at == i:
            low = min(ring)
            turn = ring[ring.index(low) :] + ring[: ring.index(low)]  # from the least on, each wants the next one's place
            n = len(ring)
            out[i] = (n, "swapped", True) if i == low else (n - turn.index(i), "swapped", False)
    for i in todo:
        out.setdefault(i, (None, "blocked", False))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_moves_that_wait(spark, seed):
    draw = random.Random(seed)
    places = {i: (i // 40, f"n{i % 40}") for i in range(200)}
    moves = {i: (draw.choice([0, 1, 2]), f"n{draw.randrange(60)}") for i in draw.sample(range(210), 150)}
    if seed == 2:  # rings of two and three, a chain of 100 to a free name and one to a name that stays
        moves = {0: places[1], 1: places[0], 2: places[3], 3: places[4], 4: places[2]} | {i: places[i + 1] for i in range(10, 109)} | {109: (9, "x")} | {i: places[i + 1] for i in range(120, 150)} | {199: places[199]}
    df = spark.createDataFrame([(i, *to) for i, to in moves.items()], "id long, parent long, name string")
    now = spark.createDataFrame([(i, *p) for i, p in places.items()], "id long, parent long, name string")
    assert {r.id: (r.round, r.outcome, r.spare) for r in chains.settled(df, now).collect()} == made_in_rounds(moves, places)


def test_ends_of_chains(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (203, 201), (300, None), (400, 999)]
    got = {r.id: (r.end, r.steps, r.low) for r in chains.ends(spark.createDataFrame(links, "id long, next long")).collect()}
    assert all(got[i] == (99, 99 - i, i) for i in range(100)) and got[300] == (300, 0, 300) and got[400] == (400, 0, 400)
    assert got[203] == (None, None, 200) and {got[i] for i in (200, 201, 202)} == {(None, None, 200)}
    assert {r.id for r in chains.reached(spark.createDataFrame(links, "id long, next long"), spark.createDataFrame([(97,), (203,), (7777,)], "id long")).collect()} == {97, 98, 99, 200, 201, 202, 203}


def fates(events):
    """One batch after another, event by event."""
    out = set()
    for batch in {e[0] for e in events}:
        seq = sorted((e for e in events if e[0] == batch), key=lambda e: e[1])
        to, on = {}, {}
        for p, e in enumerate(seq):
            if e[7]:
                to[e[3]] = p
            if e[6] or e[7] or e[8]:
                on.setdefault(e[2], []).append(p)
        for p, e in enumerate(seq):
            before = [x for x in seq[:p] if x[2] == e[2]]
            if e[6] and any(x[4] for x in before) and not any(x[5] for x in [*before, e]):
                names, at, held = [e[2]], p, None
                while held is None:
                    q = to.get(seq[at][3])
                    if q is None or q <= at:
                        held = False
                        break
                    names.append(seq[q][2])
                    later = [r for r in on[seq[q][2]] if r > q]
                    if not later:
                        held = True
                    elif seq[later[0]][6]:
                        at = later[0]
                    else:
                        held = False
                out |= {(batch, names[-1], "held")} if held else {(batch, n, "lost") for n in names}
            if e[4] and not e[5] and not [r for r in on.get(e[2], []) if r > p]:
                out.add((batch, e[2], "held"))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_created_fates(spark, seed):
    draw = random.Random(seed)
    rows = []
    for p in range(500):
        kind = draw.choice(["create", "create", "left", "left", "came", "came", "gone", "other"])
        rows.append((p // 120, p, draw.randrange(12), (p + draw.randrange(3)) // 4, kind == "create", draw.random() < 0.05, kind == "left", kind == "came", kind == "gone"))
    df = spark.createDataFrame(rows, "batch long, pos long, name long, cookie long, create boolean, folder boolean, left boolean, came boolean, gone boolean")
    assert {tuple(r) for r in chains.created_fates(df).collect()} == fates(rows)


def test_ranks_of_hot_groups(ranges):  # noqa: F811
    """Half of all rows in one group, half of those one value; null groups; over 16 ranges."""
    draw, rows = random.Random(3), []
    for _ in range(3000):
        rows.append((draw.choice(["hot", "hot", "a", None]), draw.choice([1.5, draw.random() * 9, None])))
    df = ranges.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.a, r.b, r.c) for r in ranks.nearest_ranks(df, ["g"], "v", {"a": 0, "b": 0.37, "c": 1}).collect()}
    for g in ("hot", "a", None):
        vs = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(vs[max(1, math.ceil(p * len(vs))) - 1] for p in (0, 0.37, 1))
    assert ranks.nearest_ranks(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0


def test_clock_steps_over_ranges(ranges):  # noqa: F811
    draw, rows, off = random.Random(2), [], 0
    for seq in range(800):
        off += draw.choice([0] * 20 + [-5, 5, -400_000, -3_000_000_000, 2_000_000_000])
        rows.append((seq, seq * 10**9 + off, seq * 10**9))
    held, want = None, {}
    for seq, wall, mono in rows:
        off = wall - mono
        if held is not None and off < held - clocks.JITTER_NS:
            want = {s: t - (held - off) for s, t in want.items()}
            held = off
        elif held is None or off > held:
            held = off
        want[seq] = wall
    df = ranges.createDataFrame([*rows, (None, 1, 1), (9999, None, 1)], "seq long, wall_ns long, mono_ns long")
    assert {r.seq: r.wall_ns for r in clocks.stepped_back(df).collect()} == want
    limit = want[500]
    assert clocks.stepped_back(df, limit).count() == sum(t <= limit for t in want.values())
    assert clocks.stepped_back(df.limit(0)).count() == 0


def test_least_rtt(spark):
    draw = random.Random(6)
    rows = [(draw.randrange(2), draw.randrange(1000), draw.choice([None, draw.randrange(50)])) for _ in range(400)]
    got = clocks.least_rtt(spark.createDataFrame(rows, "link long, at_ns long, rtt long"), 37).collect()
    want = [(k, t, v, min((x for j, u, x in rows if j == k and t - 37 <= u <= t and x is not None), default=None)) for k, t, v in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    times = spark.createDataFrame([(1,), (1,), (2,), (None,)], "t long").select("t", clocks.fingerprint(F.col("t")).alias("f"))
    assert len({r.f for r in times.collect()}) == 3 and times.filter("t IS NULL").first().f == 0


def test_least_rtt_of_many_rows_in_one_lifetime(spark):
    """A row's cost doesn't grow with the rows of its lifetime: 300,000 of one link within three of them."""
    rows = spark.range(300_000).select(F.lit(1).cast("long").alias("link"), F.col("id").alias("at_ns"), (F.col("id") * 7919 % 300_007).alias("rtt"))
    began = time.time()
    got = np.array([r.least for r in clocks.least_rtt(rows, 100_000).orderBy("at_ns").select("least").collect()])
    assert time.time() - began < 60
    values = np.arange(300_000, dtype=np.int64) * 7919 % 300_007
    for at in (0, 1, 99_999, 100_000, 100_001, 200_000, 234_567, 299_999):
        assert got[at] == values[max(0, at - 100_000) : at + 1].min()


TREE = "id long, parent long, name string, kind string, size long, mtime_ns long, mode int, access int, content long, meta long, seq long"


def test_states_compose(spark):
    """Changes of several steps, put in one log, give the tree that the steps give one by one."""
    rows = [(1, None, "", "Dir", 0, 0, 7, 7, 0, 0, 0)] + [(i, 1 if i < 6 else 2 + i % 4, f"n{i}", "Dir" if i < 6 else "File", i, i, i % 3, 7, i, i, i) for i in range(2, 40)]
    t = spark.createDataFrame(rows, TREE)
    moves = spark.createDataFrame([(10, 2, "new"), (11, 3, "n13"), (13, 5, "n11"), (2, 2, "loop"), (1, 2, "root"), (77, 2, "none")], "id long, parent long, name string")
    a = stored(transitions.moved(t, moves, 1000), "a")
    t1 = stored(transitions.applied(t, a), "t1")
    b = stored(transitions.transplanted(t1, spark.createDataFrame([(2, 3), (20, 21), (500, 4)], "id long, source long"), 2000), "b")
    t2 = stored(transitions.applied(t1, b), "t2")
    c, cold = (stored(x, "c") for x in transitions.collapsed(t2, spark.createDataFrame([(4,), (1,), (10,)], "id long"), 3000))
    t3 = stored(transitions.applied(t2, c), "t3")
    e = stored(transitions.expanded(t3, cold, spark.createDataFrame([(4,)], "id long"), 4000), "e")
    t4 = stored(transitions.applied(t3, e), "t4")
    rows_of = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    whole = a.unionByName(b).unionByName(c, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)
    assert rows_of(transitions.applied(t, whole)) == rows_of(t4)
    by = {r.id: r for r in t4.collect()}
    assert (by[10].parent, by[10].name) == (2, "new") and 3 not in by and 21 not in by and by[20].size == 21 and by[20].content > 2000
    assert not t2.filter("parent = 3").count() and t4.filter("parent = 4").count() == t2.filter("parent = 4").count() > 0 and by[4].seq == 3001
    gone = transitions.wiped(t4, 5000)
    assert {r.seq for r in gone.collect()} == {5001} and gone.count() == t4.count() - 1


def test_arrived_folders_stay_whole(spark):
    rows = [(1, None, "Dir", 1, 1), (2, 1, "Dir", 1, 1), (3, 2, "Dir", 1, 90), (4, 3, "File", 5, 5), (5, 2, "File", 5, 5), (6, 2, "File", 60, 5), (7, 2, "Dir", 5, 5), (8, 7, "File", 5, 5)]
    t = spark.createDataFrame(rows, "id long, parent long, kind string, seq long, meta long")
    from lignum.operators import mutations

    assert {r.id for r in mutations.kept_on_remove(t, 2, 50).filter("kept").collect()} == {1, 2, 3, 4, 6} - {1}


def test_pages_end_to_end(spark):
    """Pages of every size, one after another, give all reported changes once, and the last anchor is the end."""
    draw = random.Random(8)
    rows = [(i, draw.randrange(60), "upsert", draw.randrange(8), i, i) for i in range(1, 200)]
    df, shown = spark.createDataFrame(rows, "seq long, id long, op string, parent long, content long, wall_ns long"), spark.createDataFrame([(1,)], "id long")
    want = sorted(r.seq for r in log.changes_since(df, shown, 20, 180).collect())
    for limit in (3, 100):
        at, more, got = 20, True, []
        while more:
            page = log.page(df, shown, at, 180, limit).collect()
            got += [r.seq for r in page if r.seq is not None]
            assert len({(r.more, r.anchor) for r in page}) == 1 and page[0].anchor > at
            at, more = page[0].anchor, page[0].more
        assert sorted(got) == want and at == 180


def test_broken_reports(spark):
    good = {"version": 1, "profile": "p", "system": "own", "measurements": [{"id": "T1", "metric": "m", "value": 1.5, "unit": "ms", "better": "lower", "status": "ok", "samples": 3, "more": 1}]}
    lines = [json.dumps(good), "{", "", json.dumps(good | {"version": 3}), json.dumps({k: v for k, v in good.items() if k != "system"}), json.dumps(good | {"measurements": None}), json.dumps(good | {"measurements": [{"id": "T2"}, None]}), '{"version": "x"}']
    path = shared_folder(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = sorted((r.reason or "", r.id or "") for r in reports.read_reports(spark, path).collect())
    assert got == [("", "T1"), ("no id", ""), ("no id", "T2"), ("no profile", ""), ("not a report", ""), ("not a report", ""), ("unknown version", "")]
    assert tree.ROOT == 1
