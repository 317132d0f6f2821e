"""Every operator on ranges of an order, over many ranges that nothing merges."""

import random

import pytest
from pyspark.sql import functions as F

from lignum.operators import budget, log, sampling
from lignum.plans import registry
from tests.oracle import compare
from tests.test_sampling import kept_one_by_one

OVER_RANGES = ("time_of_seq", "server_seq_at", "resume_choice", "rate_slices", "seq_times_thinned", "evicted", "publish_order", "breadth_first", "changes_page")


@pytest.fixture
def ranges(spark):
    """16 ranges, not merged."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", OVER_RANGES)
def test_agrees_with_sql(ranges, name):
    assert compare(ranges, "/root/testdata/sf0.01", name, registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0


def test_as_of_with_hot_keys_and_ties(ranges):
    draw = random.Random(5)
    samples = [(draw.choice([50, draw.randrange(100)]), draw.choice([None, draw.randrange(1000)])) for _ in range(400)] + [(None, 3)]
    keys = [(i, draw.choice([49, 50, 51, None, draw.randrange(-5, 100)])) for i in range(3000)]
    want = {i: max(((a, v) for a, v in samples if k is not None and a is not None and v is not None and a <= k), default=(0, None))[1] for i, k in keys}
    got = log.as_of(ranges.createDataFrame(keys, "i long, k long"), ranges.createDataFrame(samples, "at long, v long"), "k", "at", "v")
    assert {r.i: r.v for r in got.collect()} == want


def test_numbered_spaced_and_evicted(ranges):
    draw, t, times = random.Random(1), 0, []
    for seq in range(2000):
        t += draw.choice([0, 1, 300, 700, 2000])
        times.append((seq, t))
    df = ranges.createDataFrame(times, "seq long, t long")
    assert {(r.seq, r.at) for r in log.numbered(df.select("seq"), F.desc("seq")).collect()} == {(s, 2000 - s) for s, _ in times}
    assert {r.seq for r in sampling.spaced(df, "seq", "t", 1000).filter("kept").collect()} == {s for s, _ in kept_one_by_one(times, 1000, 10**9)}
    cache = [(i, draw.randrange(1, 9), draw.randrange(50), i % 7 == 0) for i in range(2000)]
    held, gone = sum(c[1] for c in cache), set()
    for i, size, _, _ in sorted((c for c in cache if not c[3]), key=lambda c: (c[2], c[0])):
        if held <= 3000:
            break
        held -= size
        gone.add(i)
    assert {r.id for r in budget.evicted(ranges.createDataFrame(cache, "id long, size long, used long, pinned boolean"), 3000).collect()} == gone
