"""Cut and numbered names against the rule one at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lignum.functions import names
from lignum.operators import tree


def test_cut_between_characters(spark):
    texts = ["", "abc", "é" * 20, "日本" * 9, "a😀b" * 9, "é😀日" * 9, None]
    df = spark.createDataFrame([(t, n) for t in texts for n in range(-1, 40)], "t string, n int")
    for r in df.select("t", "n", names.cut(F.col("t"), F.col("n")).alias("c")).collect():
        assert r.c == (None if r.t is None else r.t.encode()[: max(0, r.n)].decode(errors="ignore"))


def shown(rows, marker="copy"):
    out, taken, groups = {}, {}, {}
    for parent, i, name in rows:
        taken.setdefault(parent, set()).add(names._key(name))
        groups.setdefault((parent, names._key(name)), []).append((name.encode(), name, i))
    for (parent, _), group in groups.items():
        n = 2
        for k, (_, name, i) in enumerate(sorted(group)):
            display = name
            while k and (display is name or names._key(display) in taken[parent]):
                display, n = names._marked(name, n, marker), n + 1
            out[i] = display
    return out


@pytest.mark.parametrize("seed", range(2))
def test_display_names(spark, seed):
    draw, rows, seen = random.Random(seed), [], set()
    words = ["a", "A", "b.txt", "B.txt", "B.TXT", "straße", "STRASSE", "Strasse", "é.x", "É.x", "é.x", ".env", ".ENV", "n" * 250, "N" * 250, "c (copy 2)", "C", "c", "x" * 235 + ".ab", "X" * 235 + ".ab"]
    for i in range(300):
        name = draw.choice(words)
        if draw.random() < 0.4 and len(name) < 100:
            name = names._marked(name.lower(), draw.randrange(2, 5), "copy")
        parent = draw.randrange(6)
        if (parent, name) not in seen:
            seen.add((parent, name))
            rows.append((parent, i, name))
    got = {r.id: r.display for r in names.display_names(spark.createDataFrame(rows, "parent long, id long, name string")).collect()}
    assert got == shown(rows) and len(set(got.values())) > 20
    assert names.display_names(spark.createDataFrame([], "parent long, id long, name string")).count() == 0


def test_display_bases(spark):
    df = spark.createDataFrame([("a (copy 2).txt",), ("a (copy x).txt",), ("a (copy 12)",), ("a (copy 2) (copy 3).md",), (".x (copy 2)",), ("a.txt",)], "n string")
    got = [r.b for r in df.select(names.display_base(F.col("n")).alias("b")).collect()]
    assert got == ["a.txt", None, "a", "a (copy 2).md", ".x", None]


def test_walks_to_paths(spark):
    t = spark.createDataFrame([(1, None, ""), (2, 1, "a"), (3, 2, "b"), (4, 2, "c"), (5, 77, "lost")], "id long, parent long, name string")
    wanted = spark.createDataFrame([("",), ("a",), ("a/b",), ("a/c",), ("a/b/x",), ("a//b",), ("lost",), (None,), ("a/b",)], "path string")
    over = spark.createDataFrame([(3, "c")], "id long, display string")
    assert sorted((r.path, r.id) for r in tree.resolve(t, wanted).collect() if r.id) == [("", 1), ("a", 2), ("a/b", 3), ("a/b", 3), ("a/c", 4)]
    assert {r.path: r.id for r in tree.resolve(t, wanted, over).collect()}["a/c"] == 3
    assert {r.id: r.above for r in tree.ancestor_names(t).collect()} == {2: "", 3: "a<", 4: "a<"}
    assert {(r.id, r.at) for r in tree.breadth_first(t).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_version_order(spark):
    """Against a comparison number by number."""
    import re
    from itertools import product

    from lignum.functions.codes import version_order

    def key(text):
        m = re.fullmatch(r"v?(\d+(?:\.\d+)*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", text.strip())
        return m and ([int(x) for x in m[1].split(".")], m[2].split(".") if m[2] else [])

    def order(a, b):
        x, y = key(a), key(b)
        if not x or not y:
            return None
        width = max(len(x[0]), len(y[0]))
        p, q = (k[0] + [0] * (width - len(k[0])) for k in (x, y))
        if p != q:
            return -1 if p < q else 1
        if not x[1] or not y[1]:
            return bool(y[1]) - bool(x[1])
        p, q = ([(0, int(i), "") if i.isdigit() else (1, 0, i) for i in k[1]] for k in (x, y))
        return (p > q) - (p < q)

    texts = ["1", "v1.0", "1.0.0", "1.0.1", "1.2", "1.10", "01.2", " 1.2 ", "1.2-rc.1", "1.2-rc.2", "1.2-rc.10", "1.2-rc", "1.2-rc.x", "1.2-1", "1.2-a.b-c", "1.2+b", "0", "0.0", "10.0", "", "x", "1.", "1.2-", "99999999999999999999.1"]
    df = spark.createDataFrame(list(product(texts, texts)), "a string, b string")
    got = {(r.a, r.b): r.o for r in df.select("a", "b", version_order(F.col("a"), F.col("b")).alias("o")).collect()}
    assert {k: v for k, v in got.items() if v != order(*k)} == {}
