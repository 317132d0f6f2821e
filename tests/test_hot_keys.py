"""Trees whose folders hold very many rows: their keys aren't shuffled to one task."""

import random

import pytest
from pyspark.sql import functions as F

from lignum import session
from lignum.functions import rules
from lignum.operators import chains, transitions, tree
from lignum.plans import registry
from lignum.streaming import replay, states
from tests.oracle import compare


@pytest.fixture
def hot(spark, monkeypatch):
    """Keys of more than 20 rows are hot, 3 of them at most, and Spark broadcasts nothing by itself."""
    monkeypatch.setattr(session, "HOT_ROWS", 20)
    monkeypatch.setattr(session, "HOT", 3)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that the tree's operators store."""
    seen, real = [], session.stored

    def spied(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        out = real(df, name)
        seen[-1] += (out.count(),)
        return out

    monkeypatch.setattr(tree, "stored", spied)
    return seen


def grown(n=600):
    """A tree with four hot folders, detached items, two cycles and an item above a cycle; and what lies above each."""
    draw = random.Random(4)
    up = {1: None, 2: 1, 3: 1, 4: 2, 5: 4} | {i: draw.choice([1, 2, 4, 5, 5, 5, draw.randrange(1, i)]) for i in range(6, n)}
    up |= {700: 999, 701: 700, 710: 711, 711: 710, 712: 711, 720: 720, 730: None, 731: 730}
    chains = {}
    for i in up:
        chain, at = [i], up[i]
        while at is not None and at not in chain:
            chain.append(at)
            at = up.get(at)
        chains[i] = (chain, at is None)
    return up, chains


def test_paths_and_walks_over_hot_folders(hot, plans):
    up, chains = grown()
    t = hot.createDataFrame([(i, p, f"n{i}") for i, p in up.items()], "id long, parent long, name string")
    want = {}
    for i, (chain, ends) in chains.items():
        whole = ends and chain[-1] in up
        names = [f"n{k}" for k in reversed(chain) if k != 1]
        want[i] = ("/".join(names), len(names)) if whole else (None, None)
    assert {r.id: (r.path, r.depth) for r in tree.paths(t).collect()} == want
    assert max(n for name, _, n in plans if name == "paths") <= len({p for p in up.values()})
    above = {(i, a, k) for i, (chain, ends) in chains.items() for k, a in enumerate(chain if ends else [i]) if ends or k == 0}
    assert {tuple(r) for r in tree.closure(t).collect()} == above
    assert {tuple(r) for r in tree.subtree(t, t.filter("id IN (1, 4, 5, 711)").select("id")).collect()} == {x for x in above if x[1] in (1, 4, 5, 711)}
    assert any("BroadcastHashJoin" in plan for name, plan, _ in plans if name == "reach")
    assert any("BroadcastHashJoin" in plan for name, plan, _ in plans if name == "jumps")


@pytest.mark.parametrize("name", ["breadth_first", "children_by_path", "children_of_root", "link_flips", "ordered_by_depth", "published_order", "drop_order", "kept_on_remove", "with_ancestors", "tree_closure"])
def test_tree_queries_broadcast_hot_folders_and_agree_with_sql(hot, plans, monkeypatch, sf, name):
    """Each query as registered: rows below the nations, of 6 customers or so each, aren't shuffled by their folder."""
    monkeypatch.setattr(session, "HOT_ROWS", 5)
    assert compare(hot, sf, name, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert any("BroadcastHashJoin" in plan for _, plan, _ in plans)


def test_left_join_with_hot_missing_and_null_keys(hot):
    rows = [(i, [None, 1, 2, 3, 4, i][i % 6]) for i in range(300)]
    one = [(1, "a"), (3, "c"), (5, "e"), (None, "n")]
    many = hot.createDataFrame(rows, "i long, k long")
    got = session.hot_join(many, hot.createDataFrame(one, "k long, v string"), "k", "left").select("i", "k", "v").collect()
    known = {k: v for k, v in one if k is not None}
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, k, known.get(k))) for i, k in rows)
    inner = session.hot_join(many, hot.createDataFrame(one, "k long, v string"), "k").select("i", "k", "v").collect()
    assert sorted(map(str, map(tuple, inner))) == sorted(str((i, k, known[k])) for i, k in rows if k in known)


def test_execute_verdicts_over_hot_folders(hot):
    up, chains = grown()
    rows = [(i, p, {4: "X.app"}.get(i, "Contents" if i == 5 else f"n{i}"), "File" if i > 500 else "Dir") for i, p in up.items()]
    got = {r.id for r in rules.execute_verdicts(hot.createDataFrame(rows, "id long, parent long, name string, kind string")).collect()}
    assert got == {i for i, _, _, kind in rows if kind == "File"}


def test_rings_take_rounds_by_their_length(spark, monkeypatch):
    """Short rings among many rows: a round for each doubling of the longest, not of the number of rows."""
    seen, real = [], session.stored
    monkeypatch.setattr(chains, "stored", lambda df, name: seen.append(name) or real(df, name))
    nexts = {i: i - i % 3 + (i + 1) % 3 for i in range(3000)} | {3000: 4, 3001: 3000, 3002: None, 3003: 3002, 3004: 3003, 3005: 9999, 3006: 3006}
    links = spark.createDataFrame(list(nexts.items()), "id long, next long")
    got = {r.id: (r.end, r.steps, r.low) for r in chains.ends(links).collect()}
    assert got == {i: (None, None, i - i % 3) for i in range(3000)} | {3000: (None, None, 3), 3001: (None, None, 3), 3002: (3002, 0, 3002), 3003: (3002, 1, 3002), 3004: (3002, 2, 3002), 3005: (3005, 0, 3005), 3006: (None, None, 3006)}
    assert seen.count("chains") <= 6
    starts = spark.createDataFrame([(3001,), (3004,), (7,)], "id long")
    assert {r.id for r in chains.reached(links, starts).collect()} == {3001, 3000, 3, 4, 5, 3004, 3003, 3002, 6, 7, 8}
    assert seen.count("reached") <= 6


def test_long_ring_and_a_long_way_into_it(spark):
    nexts = {i: (i + 1) % 700 for i in range(700)} | {1000 + i: 999 + i if i else 350 for i in range(300)} | {2000 + i: 1999 + i if i else None for i in range(100)}
    got = {r.id: (r.end, r.steps, r.low) for r in chains.ends(spark.createDataFrame(list(nexts.items()), "id long, next long")).collect()}
    assert got == {i: (None, None, 0) for i in range(1300) if i in nexts} | {2000 + i: (2000, i, 2000) for i in range(100)}


def test_a_snapshot_of_many_chunks_takes_few_micro_batches(spark):
    """Micro-batches go by bytes: 100 small chunks don't make 100 of them, and none holds more than it may."""
    t = spark.createDataFrame([(1, None, "")] + [(i, i // 3 + 1 if i > 3 else 1, f"n{i:04}") for i in range(2, 700)], "id long, parent long, name string")
    seen = []
    states.drained(replay.snapshot_stream(t, 1000, 10_000), lambda df, k: seen.append(df.select("chunk", "id", "bytes").collect()))
    seen = [b for b in seen if b]
    assert sorted(r.id for b in seen for r in b) == list(range(1, 700))
    chunks = {r.chunk for b in seen for r in b}
    assert len(chunks) > 80 and len(seen) <= -(-len(chunks) // 10) + 1
    assert all(sum(r.bytes for r in b) <= 10_000 for b in seen)
    assert all(sum(r.bytes for b in seen for r in b if r.chunk == c) <= 1000 for c in chunks)
    firsts = [(min(r.chunk for r in b), max(r.chunk for r in b)) for b in seen]
    assert all(a[1] < b[0] for a, b in zip(firsts, firsts[1:], strict=False))


def test_changes_are_folded_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(transitions, "PART_ROWS", 10)
    kinds = "id long, parent long, name string, kind string, size long, mtime_ns long, mode int, access int, content long, meta long, seq long"
    t = spark.createDataFrame([(i, None if i == 1 else 1, f"n{i}", "Dir", 0, 0, 0, 0, 0, 0, i) for i in range(1, 100)], kinds)
    changes = transitions.wiped(t, 500).withColumns({c: F.lit(None) for c in transitions.COLUMNS if c not in ("seq", "id")})
    left = transitions.applied(t, changes)
    assert [r.id for r in left.collect()] == [1]
    assert "hashpartitioning(id#" in (plan := left._jdf.queryExecution().optimizedPlan().toString() + left._jdf.queryExecution().executedPlan().toString()) and ", 10)" in plan
