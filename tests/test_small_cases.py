"""Edge cases on small tables, worked out by hand."""

import random

from pyspark.sql import functions as F

from lignum.functions import names, rules
from lignum.operators import budget, log, metrics, ranks, tree, workset
from lignum.streaming import keyed

LOG = "seq long, id long, op string, parent long, content long, wall_ns long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ties_in_the_fold(spark):
    rows = [(1, 7, "upsert", 1, 1, 0), (1, 7, "remove", None, None, 0), (2, 8, "remove", None, None, 0), (3, 8, "upsert", 2, 5, 0)]
    got = {r.id: (r.seq, r.op) for r in log.fold(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {7: (1, "remove"), 8: (3, "upsert")}


def test_fold_in_any_order_and_resume(spark):
    draw = random.Random(3)
    rows = [(i, draw.randrange(12), draw.choice(["upsert", "upsert", "remove"]), draw.randrange(4), draw.randrange(9), i) for i in range(1, 80)]
    rows = [r if r[2] == "upsert" else (*r[:3], None, None, r[5]) for r in rows]
    whole = {tuple(r) for r in log.fold(spark.createDataFrame(rows, LOG)).collect()}
    cut = log.fold(spark.createDataFrame(rows[:50], LOG)).unionByName(spark.createDataFrame(rows[50:], LOG).drop("wall_ns"))
    assert {tuple(r) for r in log.fold(cut).collect()} == whole
    # A client that resumes from 50 and one that loads all end alike.
    shown = spark.createDataFrame([(i,) for i in range(12)], "id long")
    since = {r.id: (r.seq, r.op) for r in log.changes_since(spark.createDataFrame(rows, LOG), shown, 50, 1000).collect()}
    old = {r.id: (r.seq, r.op) for r in log.fold(spark.createDataFrame(rows[:50], LOG)).collect()}
    assert {k: v for k, v in (old | since).items()} == {i: (s, op) for i, s, op, *_ in whole}


def test_as_of_before_the_first_sample(spark):
    keys = spark.createDataFrame([(1,), (5,), (9,), (None,)], "k long")
    samples = spark.createDataFrame([(5, 50), (7, 70)], "at long, v long")
    got = {r.k: r.v for r in log.as_of(keys, samples, "k", "at", "v").collect()}
    assert got[1] is None and got[5] == 50 and got[9] == 70


def test_paths_of_detached_and_cyclic_items(spark):
    rows = [(1, None, ""), (2, 1, "a"), (3, 2, "b"), (4, 99, "lost"), (5, 6, "x"), (6, 5, "y")] + [(100 + i, 99 + i if i else 1, f"d{i}") for i in range(40)]
    got = {r.id: (r.path, r.depth) for r in tree.paths(spark.createDataFrame(rows, "id long, parent long, name string")).collect()}
    assert got[1] == ("", 0) and got[3] == ("a/b", 2) and got[139][1] == 40
    assert got[5] == got[6] == (None, None) and got[4] == (None, None)


def test_a_walk_goes_beyond_4096_levels(spark):
    """A chain of 5,000 levels isn't taken for a cycle beside it."""
    t = spark.range(1, 5001).selectExpr("id", "nullif(id - 1, 0) AS parent").union(spark.createDataFrame([(9001, 9002), (9002, 9001), (9003, 9001)], "id long, parent long"))
    up = tree.above(t, spark.createDataFrame([(5000,), (9003,), (9001,)], "id long"))
    assert up.filter("id = 5000").count() == 5000 and up.filter("id = 5000").agg({"distance": "max"}).first()[0] == 4999
    assert {tuple(r) for r in up.filter("id > 9000").collect()} == {(9003, 9003, 0), (9001, 9001, 0)}


def test_walks_of_deep_and_cyclic_trees(spark):
    rows = [(1, None)] + [(i, i - 1) for i in range(2, 301)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000)]
    t = spark.createDataFrame(rows, "id long, parent long")
    only = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert {(r.ancestor, r.distance) for r in tree.above(t, only(300, 7777)).collect()} == {(300 - k, k) for k in range(300)}
    assert sorted((r.id, r.distance) for r in tree.subtree(t, only(200)).collect()) == [(200 + k, k) for k in range(101)]
    assert sorted(tuple(r) for r in tree.above(t, only(1003, 1001)).collect()) == [(1001, 1001, 0), (1003, 1003, 0)]
    moves = spark.createDataFrame([(5, 300), (300, 5), (7, 7)], "id long, parent long")
    assert {(r.id, r.parent): r.cycle for r in tree.would_cycle(t, moves).collect()} == {(5, 300): True, (300, 5): False, (7, 7): True}


def test_ignored_names(spark):
    hexes = "0123456789abcdefABCDEF0123456789"
    cases = {".staging-" + hexes: True, ".staging-" + hexes + ".part": True, ".staging-" + hexes[:-1] + "g": False, ".build-" + hexes: False, ".nfs01": True, "a.nfs": False, ".staging-": False}
    for name, want in cases.items():
        assert one(spark, names.is_ignored(F.lit(name))) == want, name
    assert one(spark, names.is_ignored(F.lit(".tmp-" + hexes), ".tmp-")) and one(spark, names.client_name(F.lit("\u00a0 mac book\u3000"))) == "mac book"


def test_bytes_and_characters(spark):
    e = "é"
    assert one(spark, names.cut(F.lit(e * 10), 7)) == e * 3
    assert one(spark, names.cut(F.lit("中文"), 5)) == "中"
    long = one(spark, names.numbered(F.lit("é" * 200 + ".txt"), F.lit(12)))
    assert long.endswith(" 12.txt") and len(long.encode()) in (254, 255)
    for name, want in (("a.b", ".b"), (".profile", ""), ("a.", ""), ("a.b.c", ".c"), ("", "")):
        assert one(spark, names.extension(F.lit(name))) == want
    assert [one(spark, names.is_bounce(F.lit("a.txt"), F.lit(c))) for c in ("a 2.txt", "a 1.txt", "a 12345.txt", "a2.txt", "a 2.md")] == [True, False, False, False, False]
    assert one(spark, names.client_name(F.lit("/\x07 "))) == "mac"


def test_folding_and_collisions(spark):
    rows = [(1, 1, "README"), (1, 2, "readme"), (1, 3, "Readme"), (1, 4, "readme (copy 2)"), (1, 5, "café.md"), (1, 6, "café.md"), (1, 7, "straße"), (1, 8, "STRASSE"), (2, 9, "readme")]
    got = {r.id: r.display for r in names.display_names(spark.createDataFrame(rows, "parent long, id long, name string")).collect()}
    assert got[1] == "README" and got[3] == "Readme (copy 3)" and got[2] == "readme (copy 4)" and got[4] == "readme (copy 2)"
    assert got[6] == "café.md" and got[5] == "café (copy 2).md" and got[9] == "readme"
    assert {got[7], got[8]} == {"STRASSE", "straße (copy 2)"}


def test_terminal_and_links(spark):
    df = spark.createDataFrame([("a\tb‮c",)], "x string")
    assert df.select(names.for_terminal("x").alias("y")).first().y == "a\\u{9}b\\u{202e}c"
    shown = lambda t, depth, root="/r": one(spark, rules.link_shown(F.lit(t), F.lit(depth), F.lit(root)))
    assert (shown("/r/a", 2), shown("/ra/x", 1), shown("../..", 3), shown("", 1), shown("/a", 1, "/")) == ("../../a", None, None, None, "../a")


def test_percentiles(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    got = ranks.nearest_ranks(df, [], "v", {"a": 0, "b": 0.5, "c": 0.99, "d": 1}).first()
    assert tuple(got) == (1.0, 50.0, 99.0, 100.0)
    odd = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (float("inf"), 3), (None, 4), (3.0, 5)], "v double, at int").withColumn("g", F.lit(1))
    row = metrics.summary(odd, ["g"], "v", "at").first()
    assert (row.n, row.least, row.greatest, row["last"]) == (2, 1.0, 3.0, 3.0)


def test_unknown_verdicts(spark):
    t = lambda v: F.lit(v).cast("boolean")
    got = [one(spark, metrics.both_known(t(a), t(b))) for a, b in ((True, None), (None, False), (True, False), (None, None))]
    assert got == [True, False, False, None]
    assert one(spark, metrics.cold_limit(256 * 1024.0, F.lit(40), F.lit(6_250_000))) > 286


def test_eviction_and_packing(spark):
    cache = spark.createDataFrame([(1, 50, 1, False), (2, 50, 2, True), (3, 50, 3, False), (4, 50, 4, False)], "id long, size long, used long, pinned boolean")
    assert {r.id for r in budget.evicted(cache, 120).collect()} == {1, 3}
    rows = spark.createDataFrame([(1, 1, 40), (1, 2, 30), (1, 3, 100), (1, 4, 10)], "k long, o long, n long")
    assert [r.frame for r in budget.packed(rows, "k", "o", "n", 60).orderBy("o").collect()] == [0, 1, 2, 3]


def test_identity_with_unknown_birth(spark):
    ddl = "id long, dev int, ino int, kind string, born int"
    seen = spark.createDataFrame([(1, 1, 5, "File", None), (2, 1, 6, "File", 3)], ddl)
    known = spark.createDataFrame([(10, 1, 5, "File", 9), (11, 1, 6, "File", 4)], ddl)
    assert {r.seen: r.known for r in workset.identified(seen, known).collect()} == {1: 10, 2: None}


def test_refused_batches_leave_the_state(spark):
    table = keyed.KeyedTable(spark, guard=lambda batch, before: batch.filter("op = 'remove'").count() > 1)
    table.apply(spark.createDataFrame([(1, 1, "upsert", 0, 0, 0), (2, 2, "upsert", 0, 0, 0)], LOG), 0)
    table.apply(spark.createDataFrame([(3, 1, "remove", None, None, 0), (4, 2, "remove", None, None, 0)], LOG), 1)
    assert table.refused == [1] and {r.op for r in table.read().collect()} == {"upsert"}
