"""What streams do once: a batch that is published is computed once, and a key's state is read and written once a call."""

import pandas as pd

from lignum.streaming import states
from lignum.streaming.keyed import Publisher


def test_a_published_batch_is_computed_once(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            met.add(len(f))
            yield f

    rows = spark.range(100).selectExpr("id", "id % 7 AS t").mapInPandas(counted, "id long, t long")
    out = Publisher(spark, ["t", "id"])
    out.apply(rows, 0)
    assert met.value == 100
    assert [(r.t, r.id) for r in out.read().orderBy("issued").collect()] == sorted((i % 7, i) for i in range(100))


class Held:
    """A state and its timers, which count what is asked of them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, fields):  # noqa: N802
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class Times:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs  # noqa: N815


def test_state_is_read_once_and_written_where_it_changes():
    ms, held = 1_000_000, Held()
    throttle = states._Throttle(100 * ms, 30 * ms)
    throttle.init(held)
    frame = lambda *rows: pd.DataFrame([(7, s, t * ms, c, p) for s, t, c, p in rows], columns=["id", "seq", "at_ns", "closed", "passes"])
    run = lambda found: [tuple(r) for f in found for r in f.itertuples(index=False)]
    assert run(throttle.handleInputRows((7,), [frame((2, 10, False, False)), frame((1, 0, False, False))], None)) == [(7, 1, 0, False)]
    assert held.calls == ["get", "update"] and held.timers == {40}
    held.calls.clear()
    assert run(throttle.handleInputRows((7,), [frame((3, 20, False, True))], None)) == [(7, 3, 20 * ms, False)]
    assert held.calls == ["get"] and held.timers == {40}  # what passes leaves all else as it is
    held.calls.clear()
    held.timers.remove(40)
    assert run(throttle.handleExpiredTimer((7,), Times(40), Times(40))) == [(7, 2, 40 * ms, True)]
    assert held.calls == ["get", "update"] and not held.timers and held.value[-1] is None
