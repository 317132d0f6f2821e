"""Thinning and marks against a simulation of the rule."""

import random

import pytest

from lignum.operators.sampling import rate_slices, spaced, thinned


def kept_one_by_one(times, gap, most):
    out = []
    for seq, t in times:
        if not out or t - out[-1][1] > gap:
            out.append((seq, t))
            if len(out) > most:
                out = out[::2]
    return out


@pytest.mark.parametrize("n,most", [(0, 10), (1, 10), (300, 1000), (300, 10), (1200, 40)])
def test_thinned(spark, n, most):
    draw, t, times = random.Random(n), 0, []
    for seq in range(n):
        t += draw.choice([0, 1, 300, 700, 2000])
        times.append((seq, t))
    got = thinned(spark.createDataFrame(times, "seq long, wall_ns long"), 1000, most).collect()
    assert sorted((r.seq, r.wall_ns) for r in got) == kept_one_by_one(times, 1000, most)


def test_only_kept_samples_count(spark):
    """0, 0.6 and 1.2: the last is compared with the first."""
    rows = [(1, 0), (2, 600), (3, 1200), (4, None)]
    got = spaced(spark.createDataFrame(rows, "seq long, wall_ns long"), "seq", "wall_ns", 1000).collect()
    assert {r.seq: r.kept for r in got} == {1: True, 2: False, 3: True}


def test_rate_slices(spark):
    rows = [(1, 0, 5), (2, 60, 10), (3, 110, 20), (4, 200, 1), (5, 900, 7), (6, 1000, 9), (7, 1050, 3)]
    got = rate_slices(spark.createDataFrame(rows, "seq long, wall_ns long, bytes long"), 100, 500).orderBy("start_ns").collect()
    assert [(r.start_ns, r.bytes, r.elapsed_ns) for r in got] == [(0, 30, 110), (900, 9, 100)]
    assert got[0].rate == got[1].best == 30e9 / 110
    assert rate_slices(spark.createDataFrame([], "seq long, wall_ns long, bytes long"), 100, 500).count() == 0
