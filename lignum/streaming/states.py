"""Streams with state of their own by key: batches after quiet, throttles, halves of renames.

State is a few numbers a key, in the session's state store; what is due without further rows comes by event-time
timers. Rows of a key are taken in order of time within a micro-batch, and micro-batches are expected in
order (``replay.replayed``, or a source that is late by less than the watermark allows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lignum.operators import log as logs
from lignum.session import hot_join, shared_folder
from lignum.sources.relations import change_log, with_views
from lignum.streaming.keyed import KeyedTable, OpLog, Publisher
from lignum.streaming.replay import chunk_stream, replayed, snapshot_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, each, checkpoint: str | None = None, mode: str = "append") -> None:
    """Runs a stream over all that is there, batch by batch; with the same ``checkpoint`` it goes on where it was.

    Each micro-batch opens every partition of the state, so there are two a core at most; a checkpoint keeps their number.
    """
    spark = stream.sparkSession
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], ROCKS)
    spark.conf.set(names[1], min(int(spark.conf.get(names[1])), 2 * spark.sparkContext.defaultParallelism))
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or shared_folder(spark, "stream")).foreachBatch(each).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value) if value else spark.conf.unset(n)


def collected(stream: DataFrame) -> DataFrame:
    """All that a stream gives, as a table; a batch that runs again replaces itself."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, "stream-out")
    drained(stream, lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/micro_batch={k}"))
    return spark.read.parquet(folder).select(stream.columns)


def steps(settle: int, step: int, most: int) -> list[int]:
    """When a batch is looked at, after its first event: each ``settle`` up to ``step``, then each ``step``, until ``most`` has passed."""
    out = [0]
    while not out[-1] >= most:
        out.append(out[-1] + (settle if out[-1] < step else step))
    return out[1:]


class _Timed(StatefulProcessor):
    """Keeps a tuple and one timer a key. ``take`` and ``due`` change ``self.now`` and give rows out."""

    fields, taken = "", ()

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.fields + ", timer long")

    def take(self, at: int, seq: int, *more) -> Iterator[tuple]:
        """A row at a time: its time, number, and what ``taken`` names."""

    def due(self, until: int) -> Iterator[tuple]:
        """What is due before ``until``."""

    def next_due(self) -> int | None:
        """The time, in nanoseconds, by which something is due without further rows."""

    def _run(self, key, work, fired: int | None = None) -> Iterator[pd.DataFrame]:
        """Each call on the state or a timer is a round trip: one read, and no more writes than there are changes."""
        held = self.state.get()
        self.now, timer = (tuple(held[:-1]), held[-1]) if held else (None, None)
        if timer == fired:
            timer = None  # a timer that has fired is gone
        rows = list(work())
        wanted = self.next_due() if self.now else None
        wanted = None if wanted is None else -(-wanted // 1_000_000)
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None and timer != wanted:
            self.handle.registerTimer(wanted)
        if self.now:
            if not held or (*self.now, wanted) != tuple(held):
                self.state.update((*self.now, wanted))
        elif held:
            self.state.clear()
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        def work():
            # Plain arrays: most keys have a few rows a micro-batch, for which frames cost more than the rows.
            frames = list(rows)
            at, seq, *more = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("at_ns", "seq", *self.taken))
            order = np.lexsort((seq, at))
            for row in zip(*(x[order].tolist() for x in (at, seq, *more)), strict=True):
                yield from self.take(*row)

        yield from self._run(key, work)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, seen = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()

        def work():  # all up to the watermark: a timer set now would wait for the next micro-batch
            yield from self.due(max(fired, seen) * 1_000_000 + 1)

        yield from self._run(key, work, fired)

    def close(self) -> None:
        pass


class _Quiet(_Timed):
    fields = "begun long, step int, grew boolean, n long, first long, last long"
    columns = ("id", "begun_ns", "closed_ns", "n", "first_seq", "last_seq")

    def __init__(self, settle: int, step: int, most: int):
        self.steps = steps(settle, step, most)

    def due(self, until):
        while self.now:
            begun, k, grew, n, first, last = self.now
            if begun + self.steps[k] >= until:
                return
            if not grew or k == len(self.steps) - 1:
                yield (begun, begun + self.steps[k], n, first, last)
                self.now = None
            else:
                self.now = (begun, k + 1, False, n, first, last)

    def take(self, at, seq):
        yield from self.due(at)
        if self.now is None:
            self.now = (at, 0, False, 1, seq, seq)
        else:
            begun, k, grew, n, first, _ = self.now
            self.now = (begun, k, grew or at > begun, n + 1, first, seq)

    def next_due(self):
        return self.now[0] + self.steps[self.now[1]]


class _Throttle(_Timed):
    fields = "said long, since long, seq long"
    columns, taken = ("id", "seq", "published_ns", "held"), ("closed", "passes")

    def __init__(self, gap: int, quiet: int):
        self.gap, self.quiet = gap, quiet

    def next_due(self):
        said, since, _ = self.now
        return None if since is None else min(since + self.quiet, said + self.gap)

    def due(self, until):
        at = self.next_due() if self.now else None
        if at is not None and at < until:
            yield (self.now[2], at, True)
            self.now = (at, None, None)

    def take(self, at, seq, closed, passes):
        yield from self.due(at + 1)
        said = self.now[0] if self.now else None
        if passes:
            yield (seq, at, False)
        elif closed or said is None or at - said >= self.gap:
            yield (seq, at, False)
            self.now = (at, None, None)
        else:
            self.now = (said, at, seq)


def _keyed(stream: DataFrame, processor: StatefulProcessor, ddl: str, late: str) -> DataFrame:
    marked = stream.withColumn("at", F.timestamp_micros(F.expr("at_ns div 1000"))).withWatermark("at", late)
    return marked.groupBy("id").transformWithStateInPandas(processor, ddl, "Append", "EventTime")


def quiet_batches(stream: DataFrame, settle_ns: int = 2_000_000, step_ns: int = 8_000_000, most_ns: int = 50_000_000, late: str = "1 second") -> DataFrame:
    """Batches of each ``id``'s rows (``id, seq, at_ns``): ``id, begun_ns, closed_ns, n, first_seq, last_seq``.

    A batch begins with a row. It is looked at each ``settle_ns`` until ``step_ns`` have passed, then each ``step_ns``, and
    is closed when nothing has come since it was looked at last, or ``most_ns`` have passed.
    """
    return _keyed(stream.select("id", "seq", "at_ns"), _Quiet(settle_ns, step_ns, most_ns), "id long, begun_ns long, closed_ns long, n long, first_seq long, last_seq long", late)


def throttled(stream: DataFrame, gap_ns: int = 1_000_000_000, quiet_ns: int = 300_000_000, late: str = "1 second") -> DataFrame:
    """When each ``id``'s changes (``id, seq, at_ns, closed, passes``) are published: ``id, seq, published_ns, held``.

    A change goes out at once if none did for ``gap_ns``, or it was ``closed``; else it is held, in place of one held before,
    until nothing has come for ``quiet_ns`` or the last one out is ``gap_ns`` ago. A change that ``passes`` (new items,
    attributes) goes out at once and leaves all else as it is.
    """
    return _keyed(stream.select("id", "seq", "at_ns", "closed", "passes"), _Throttle(gap_ns, quiet_ns), "id long, seq long, published_ns long, held boolean", late)


def rename_pairs(halves: DataFrame, within: str, late: str = "1 second") -> DataFrame:
    """Renames from a stream of ``seq, half, cookie, at``: ``cookie, from_seq, to_seq``, one of them null where a half stays alone.

    A ``to`` belongs to a ``from`` of its cookie that is not later than it and no more than ``within`` before it. A half
    comes out alone when the watermark says that no partner can come.
    """
    side = lambda h, n: halves.filter(F.col("half") == h).select(F.col("cookie").alias(f"{n}_cookie"), F.col("seq").alias(f"{n}_seq"), F.col("at").alias(f"{n}_at")).withWatermark(f"{n}_at", late)
    pair = F.expr(f"from_cookie = to_cookie AND to_at >= from_at AND to_at <= from_at + INTERVAL {within}")
    return side("from", "from").join(side("to", "to"), pair, "full_outer").select(F.coalesce("from_cookie", "to_cookie").alias("cookie"), "from_seq", "to_seq")


MINUTE = 60_000_000_000
FAR = 100 * 24 * 60 * MINUTE


def _replayed(rows: DataFrame, **fixed) -> DataFrame:
    """Rows of the log in order, and at the end rows of key -1 that move time on past all others."""
    far = rows.agg((F.max("at_ns") + FAR).alias("at_ns")).select("at_ns", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    last = far.select(*[fixed[c](F.col("k")).cast(t).alias(c) if c in fixed else F.col(c) for c, t in rows.dtypes])
    return replayed(rows, "seq", files=6, per_batch=2, closing=last)


def _quiet(s: SparkSession, d: str) -> DataFrame:
    rows = change_log(s, d).select("id", "seq", F.col("wall_ns").alias("at_ns"))
    stream = _replayed(rows, id=lambda k: F.lit(-1), seq=lambda k: -1 - k)
    return collected(quiet_batches(stream, 200 * MINUTE, 800 * MINUTE, 5000 * MINUTE)).filter("id >= 0")


def _changes(s: SparkSession, d: str) -> DataFrame:
    rows = change_log(s, d).select("id", "seq", F.col("wall_ns").alias("at_ns"), F.coalesce(F.col("content") % 5 == 0, F.lit(False)).alias("closed"), F.coalesce(F.col("content") % 7 == 0, F.lit(True)).alias("passes"))
    stream = _replayed(rows, id=lambda k: F.lit(-1), seq=lambda k: -1 - k, closed=lambda k: F.lit(True), passes=lambda k: F.lit(False))
    return throttled(stream, 600 * MINUTE, 180 * MINUTE).filter("id >= 0")


def _late(s: SparkSession, d: str) -> DataFrame:
    """The published log; each id's publications must come in the order of their times."""
    out = Publisher(s, ["published_ns", "id", "seq"])
    drained(_changes(s, d), out.apply)
    log = out.read()
    by = logs.Window.partitionBy("id").orderBy("issued")
    return log.withColumn("earlier", F.lag("published_ns").over(by)).select("id", "seq", "published_ns", "held", F.coalesce(F.col("earlier") <= F.col("published_ns"), F.lit(True)).alias("in_order"))


def _renames(s: SparkSession, d: str) -> DataFrame:
    half = F.when(F.col("content") % 3 == 0, "from").when(F.col("content") % 3 == 1, "to")
    rows = change_log(s, d).select("seq", half.alias("half"), F.floor(F.col("seq") / 6).alias("cookie"), F.col("wall_ns").alias("at_ns")).filter("half IS NOT NULL")
    stream = _replayed(rows, seq=lambda k: -1 - k, half=lambda k: F.when(k == 0, "from").otherwise("to"), cookie=lambda k: -1 - k)
    return collected(rename_pairs(stream.withColumn("at", F.timestamp_micros(F.expr("at_ns div 1000"))), "12 MINUTES")).filter("cookie >= 0")


class Stopped(Exception):
    pass


def _sink(s: SparkSession, d: str) -> DataFrame:
    """The log streamed into a keyed table that is stopped half way, and gone on with by another object."""
    stream, folder, checkpoint = replayed(change_log(s, d), "seq", files=6, per_batch=2), shared_folder(s, "keyed"), shared_folder(s, "stream")

    def until(df, k):
        if k == 1:
            raise Stopped
        KeyedTable(s, folder, 16).apply(df, k)

    try:
        drained(stream, until, checkpoint)
    except Exception as stopped:
        if "Stopped" not in str(stopped):
            raise
    drained(stream, KeyedTable(s, folder, 16).apply, checkpoint)
    return KeyedTable(s, folder, 16).read()


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    """The tree from its stream: each folder must have come before, or with, what lies in it, and no chunk is larger than the bound."""
    from lignum.sources.relations import items

    rows = collected(snapshot_stream(items(s, d), 60_000))
    size = rows.groupBy("chunk").agg(F.sum("bytes").alias("held"))
    up = rows.select(F.col("id").alias("parent"), F.col("chunk").alias("above"))
    whole = hot_join(rows.join(size, "chunk"), up, "parent", "left")
    return whole.select("id", "parent", "name", "depth", (F.col("held") <= 60_000).alias("fits"), F.coalesce(F.col("above") <= F.col("chunk"), F.col("parent").isNull()).alias("after_parent"))


OPS, OPS_HELD, OPS_TTL, OPS_CHUNKS = 700, 500, 5000 * MINUTE, 12


def _ops(s: SparkSession, d: str) -> DataFrame:
    """The log as ops that come again, in twelve micro-batches."""
    rows = change_log(s, d).select("seq", (F.col("seq") % OPS).alias("op"), F.col("wall_ns").alias("done_ns"))
    end = rows.agg((F.max("seq") + 1).alias("end"))  # one row
    chunks = rows.crossJoin(F.broadcast(end)).select("op", "done_ns", F.expr(f"seq * {OPS_CHUNKS} div end").alias("chunk"))
    log = OpLog(s, OPS_TTL, OPS_HELD)
    drained(chunk_stream(chunks), log.apply)
    return log.read()


def _steps_sql(settle: int, step: int, most: int) -> str:
    ends = steps(settle, step, most)
    return ", ".join(f"({a}::BIGINT, {b}::BIGINT, {'true' if b == ends[-1] else 'false'})" for a, b in zip([0, *ends], ends, strict=False))


QUERIES = {"keyed_sink": _sink, "rename_pairs": _renames, "quiet_batches": _quiet, "throttled": lambda s, d: collected(_changes(s, d)), "late_published": _late, "snapshot_stream": _snapshot, "ops_once": _ops}
_THROTTLED = f"""e AS MATERIALIZED (SELECT id, seq, wall_ns AS t, coalesce(content % 5 = 0, false) AS closed, coalesce(content % 7 = 0, true) AS passes, row_number() OVER (PARTITION BY id ORDER BY wall_ns, seq) AS k FROM change_log),
dues AS (SELECT id, 0 AS k, NULL::BIGINT AS said, NULL::BIGINT AS since, NULL::BIGINT AS held, NULL::BIGINT AS out_at, NULL::BIGINT AS out_seq, NULL::BIGINT AS own_at, NULL::BIGINT AS own_seq FROM e WHERE k = 1
  UNION ALL SELECT id, k, CASE WHEN goes THEN t ELSE said1 END, CASE WHEN goes THEN NULL WHEN passes THEN since1 ELSE t END, CASE WHEN goes THEN NULL WHEN passes THEN held1 ELSE seq END, out_at, out_seq,
    CASE WHEN goes OR passes THEN t END, CASE WHEN goes OR passes THEN seq END FROM (
    SELECT *, NOT passes AND (closed OR said1 IS NULL OR t - said1 >= {600 * MINUTE}) AS goes FROM (
      SELECT e.id, e.k, e.t, e.seq, e.closed, e.passes, CASE WHEN due <= e.t THEN due ELSE said END AS said1, CASE WHEN due <= e.t THEN NULL ELSE since END AS since1, CASE WHEN due <= e.t THEN NULL ELSE held END AS held1,
        CASE WHEN due <= e.t THEN due END AS out_at, CASE WHEN due <= e.t THEN held END AS out_seq
      FROM (SELECT *, CASE WHEN since IS NOT NULL THEN least(since + {180 * MINUTE}, said + {600 * MINUTE}) END AS due FROM dues) d JOIN e ON e.id = d.id AND e.k = d.k + 1))),
ended AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS r FROM dues),
said AS (SELECT id, out_seq AS seq, out_at AS published_ns, true AS held FROM dues WHERE out_at IS NOT NULL UNION ALL SELECT id, own_seq, own_at, false FROM dues WHERE own_at IS NOT NULL
  UNION ALL SELECT id, held, least(since + {180 * MINUTE}, said + {600 * MINUTE}), true FROM ended WHERE r = 1 AND since IS NOT NULL)"""
_RECURSIVE = lambda body: with_views(body, "change_log").replace("WITH ", "WITH RECURSIVE ", 1).replace(")\n, ", "),\n")
ORACLE_SQL = {
    "keyed_sink": logs.ORACLE_SQL["lww_fold"],
    "rename_pairs": with_views(
        """, h AS (SELECT seq, CASE content % 3 WHEN 0 THEN 'from' WHEN 1 THEN 'to' END AS half, seq // 6 AS cookie, wall_ns FROM change_log WHERE content % 3 IN (0, 1))
SELECT coalesce(f.cookie, t.cookie) AS cookie, f.seq AS from_seq, t.seq AS to_seq FROM (SELECT * FROM h WHERE half = 'from') f FULL JOIN (SELECT * FROM h WHERE half = 'to') t
  ON f.cookie = t.cookie AND t.wall_ns BETWEEN f.wall_ns AND f.wall_ns + 720000000000""", "change_log"
    ).replace(")\n, ", "),\n"),
    "quiet_batches": _RECURSIVE(
        f""", e AS MATERIALIZED (SELECT id, seq, wall_ns AS t FROM change_log), looks(a, b, final) AS (VALUES {_steps_sql(200 * MINUTE, 800 * MINUTE, 5000 * MINUTE)}),
grown AS (SELECT DISTINCT s.id, s.t, l.b FROM e s JOIN e x ON x.id = s.id AND x.t > s.t JOIN looks l ON x.t > s.t + l.a AND x.t <= s.t + l.b AND NOT l.final),
ends AS MATERIALIZED (SELECT s.id, s.t, min(s.t + l.b) AS closed FROM (SELECT DISTINCT id, t FROM e) s CROSS JOIN looks l WHERE NOT EXISTS (SELECT 1 FROM grown g WHERE g.id = s.id AND g.t = s.t AND g.b = l.b) GROUP BY 1, 2),
follow AS MATERIALIZED (SELECT a.id, a.t, a.closed, (SELECT min(b.t) FROM ends b WHERE b.id = a.id AND b.t > a.closed) AS after FROM ends a),
chain AS (SELECT f.* FROM follow f WHERE t = (SELECT min(t) FROM ends m WHERE m.id = f.id) UNION ALL SELECT f.* FROM chain c JOIN follow f ON f.id = c.id AND f.t = c.after)
SELECT c.id, c.t AS begun_ns, c.closed AS closed_ns, count(*) AS n, min_by(e.seq, (e.t, e.seq)) AS first_seq, max_by(e.seq, (e.t, e.seq)) AS last_seq FROM chain c JOIN e ON e.id = c.id AND e.t BETWEEN c.t AND c.closed GROUP BY 1, 2, 3"""
    ),
    "throttled": _RECURSIVE(f", {_THROTTLED} SELECT id, seq, published_ns, held FROM said"),
    "late_published": _RECURSIVE(f", {_THROTTLED} SELECT id, seq, published_ns, held, true AS in_order FROM said"),
    "ops_once": _RECURSIVE(
        f""", r AS (SELECT seq * {OPS_CHUNKS} // (SELECT max(seq) + 1 FROM change_log) AS chunk, wall_ns AS done_ns, seq % {OPS} AS op FROM change_log),
per AS MATERIALIZED (SELECT chunk, list({{'done_ns': done_ns, 'op': op}} ORDER BY op, done_ns) AS rows FROM r GROUP BY 1),
state AS (SELECT -1::BIGINT AS chunk, []::STRUCT(done_ns BIGINT, op BIGINT)[] AS held, []::STRUCT(done_ns BIGINT, op BIGINT)[] AS done, 0::BIGINT AS before
  UNION ALL SELECT chunk, (held || done)[-{OPS_HELD}:], done, before FROM (
    SELECT chunk, held, list_sort(list_filter(fresh, lambda x, i: i = 1 OR fresh[i - 1].op <> x.op)) AS done, before FROM (
      SELECT p.chunk, s.held, s.before + len(s.done) AS before, list_filter(p.rows, lambda x: len(list_filter(s.held, lambda h: h.op = x.op AND x.done_ns - h.done_ns <= {OPS_TTL})) = 0) AS fresh
      FROM state s JOIN per p ON p.chunk = s.chunk + 1)))
SELECT d.op, d.done_ns, before + i AS issued FROM (SELECT unnest(done) AS d, generate_subscripts(done, 1) AS i, before FROM state)"""
    ),
    "snapshot_stream": with_views("SELECT i.id, i.parent, i.name, p.depth, true AS fits, true AS after_parent FROM items i JOIN paths p ON p.id = i.id", "items", "paths"),
}
