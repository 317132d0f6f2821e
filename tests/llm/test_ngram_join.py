import random
import re

import pytest

from lignum.llm import ngram_join
from lignum.llm import components as components_module
from lignum.llm.common import written
from lignum.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(draw, start, n, length, words):
    base = [draw.choice(words) for _ in range(length)]
    for i in range(n):
        copy = base[:]
        for _ in range(draw.randint(0, 5)):
            copy[draw.randrange(length)] = draw.choice(words)
        yield start + i, " ".join(copy[: length - draw.randint(0, 3)])


@pytest.mark.parametrize("tile", [4, 256])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(500)] + ["É", "the", "The"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "a b c d"), (7, "É é"), (8, "e\x0bf g\x85h i j"), (9, "The the THE the the")]
    rows += near_copies(draw, 100, 90, 110, words)
    rows += near_copies(draw, 300, 25, 40, words)
    rows += near_copies(draw, 400, 6, 3000, words)
    passage = " ".join(draw.choice(words) for _ in range(60))
    rows += [(500 + i, passage + " " + " ".join(draw.choice(words) for _ in range(draw.randint(3, 80)))) for i in range(40)]
    rows += [(600 + i, rows[20][1]) for i in range(12)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "7 AS n", "'x' AS whole")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute(rows, 4, 85)


def test_odd_rows(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (9, "a b c d e"), (None, None)]
    got = sorted(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert [tuple(r) for r in got] == [(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 0, None), (None, 2, None)]
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stars_take_one_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components_module, "written", lambda df, name: rounds.append(name) or written(df, name))
    stars = [(3, 1), (2, 1), (5, 4), (2, 1), (7, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 4}
    assert len(rounds) == 2  # the edges and one round


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 150: 100, 200: 100}
