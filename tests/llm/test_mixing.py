import re

from pyspark.sql import functions as F

from lignum.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total >= most * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def test_targets_and_totals(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 7}" if i % 3 else "hot", "x") for i in range(900)]
    rows += [(10_000 + i, "a b c", None, "x") for i in range(3)] + [(20_000, None, "s1", "x"), (20_001, "", "s1", "x"), (20_002, " \t", "tiny", "x"), (None, "q", "s2", "x")]
    rows += [rows[5]] * 4
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = filled(sizes)
    got = mixing.mix(frame(spark, rows), fan=8)
    assert got.count() == len(rows)
    by = {r.source: r for r in got.join(frame(spark, rows).select("doc_id", "source").distinct(), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.first("source_size").alias("s")).collect()}
    for source, t in want.items():
        if source is None or source not in by:
            continue
        assert by[source].s == sizes[source] and abs(by[source].t - t) < 1e-6 * max(1, t)
        if source not in ("s2",):  # its row without an id is not in the join
            assert abs(by[source].k - t) <= 50, source
    assert not got.filter("taken > 3 * size or taken % greatest(size, 1) != 0").count()


def test_same_mix_however_dealt(spark):
    rows = [(i, "w " * (1 + i % 13), f"s{i % 3}", "x") for i in range(300)]
    a = mixing.mix(frame(spark, rows).repartition(3), fan=8).select("doc_id", "taken").collect()
    b = mixing.mix(frame(spark, rows[::-1]).repartition(7), fan=8).select("doc_id", "taken").collect()
    assert sorted(a) == sorted(b)


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_rows_without_ids_and_repeated_rows(spark):
    """A third of all rows has no id, a third repeats one: each row counts, and no source misses its target by more than a document."""
    rows = [(None, "w " * (1 + i % 5), f"s{i % 3}", "x") for i in range(400)] + [(7, "a b c", "s0", "x")] * 300 + [(i, "w " * (1 + i % 20), f"s{i % 3}", "x") for i in range(100, 400)]
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    got = mixing.mix(frame(spark, rows), fan=8).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(t.split())) for i, t, _, _ in rows)
    want = filled(sizes)
    by = {r.source_size: 0 for r in got}
    assert len(by) == 3  # the sources differ in size, so their rows can be told apart
    for r in got:
        by[r.source_size] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    for source, t in want.items():
        assert abs(by[sizes[source]] - t) <= 20
    for source in range(3):  # rows alike are taken equally often but for one copy
        alike = [r.copies for r in got if r.doc_id == 7 and r.source_size == sizes["s0"]]
        assert max(alike) - min(alike) <= 1


def test_key_tells_rows_apart(spark):
    rows = [(1, "a b", "s", "x"), (1, "c d", "s", "y"), (None, "e f", "s", "z")]
    got = mixing.mix(frame(spark, rows), key="taken")
    assert {(r.key, r.copies) for r in got.collect()} == {("x", 1), ("y", 1), ("z", 1)}


def test_many_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 3)
    got = mixing.mix(frame(spark, [(5, "a", "s", "x")] * 11)).collect()
    assert [tuple(r) for r in got] == [(5, 1, 11, 11.0, 1, 1)] * 11
