"""The prefix trie against a trie built turn by turn."""

import hashlib
import random
import zlib

import pytest

from lignum.llm import prefix_trie
from lignum.llm.ranges import dense_names, running_sums

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n long"


def told(turns):
    """Rows of the trie of ``{conv: [(role, text)]}``."""
    nodes = {}
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(turns[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            r, t = (hashlib.sha256((x or "").encode()).hexdigest() for x in (role, text))
            out.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256((r + t).encode()).hexdigest(), role or "", text or ""))
    return {c: [x[3:] for x in sorted(ts)] for c, ts in out.items()}


def again(turns):
    out = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + ts[h:]
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [0, 2])
def test_against_a_trie(spark, seed):
    draw, rows = random.Random(seed), []
    for c in range(0, 60, 1 + seed):
        for turn in range(draw.choice([0, 1, 2, 3, 9, 33])):
            rows.append((c * 7 - 20, draw.choice([turn, turn, None]), draw.choice(["user", None, "é"]), draw.choice(["", "a", None, "ü" * 9]), "x", 5))
    rows += [(None, 0, "user", "q", "x", 5)] + rows[:3]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(prefix_trie.trie(turns, turns.select("conv_id").distinct())) == told(ordered(rows))
    assert rows_of(prefix_trie.trie(*prefix_trie.rebuilt(turns))) == told(again(ordered(rows)))


def test_hot_turns_and_many_ends(spark, monkeypatch):
    """Equal conversations end in one node, whose ids are hashed in many blocks; one conversation has most turns."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, t, "user", "same", "x", 5) for c in range(200) for t in range(2)] + [(900, t, "user", "same" if t % 3 else "é", "x", 5) for t in range(130)]
    rows += [(901, t, "user", "same", "x", 5) for t in range(2)]
    small = [r for r in rows if r[0] != 900] + [r for r in rows if r[0] == 900][:40]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(small, SCHEMA))
    assert rows_of(prefix_trie.trie(turns, turns.select("conv_id").distinct())) == told(ordered(small))
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    found = prefix_trie.trie(turns, turns.select("conv_id").distinct()).agg({"depth": "max", "*": "count"}).first()
    assert sorted(found) == [130, 133]


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    turns = prefix_trie.numbered_turns(none)
    assert prefix_trie.trie(*prefix_trie.rebuilt(turns)).count() == 0
    alone = prefix_trie.trie(turns, spark.createDataFrame([(4,), (9,)], "conv_id long"))
    assert rows_of(alone) == told({4: [], 9: []})


@pytest.mark.parametrize("n", [1, 16])
def test_ranges(spark, n):
    """Names and sums over many ranges that nothing merges, with a key that has half the rows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        draw = random.Random(n)
        rows = [(draw.choice([7, draw.randrange(40)]), i, draw.randrange(5)) for i in range(3000)]
        df = spark.createDataFrame(rows, "g long, i long, v long")
        names = {r.g: r.name for r in dense_names(df, ["g"]).collect()}
        assert names == {g: k + 1 for k, g in enumerate(sorted({r[0] for r in rows}))}
        got = {r.i: (r.s, r.c) for r in running_sums(df.selectExpr("*", "1 AS one"), "g", [df.i], {"v": "s", "one": "c"}).collect()}
        sums = {}
        for g, i, v in rows:
            s, c = sums.get(g, (0, 0))
            sums[g] = (s + v, c + 1)
            assert got[i] == sums[g]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
