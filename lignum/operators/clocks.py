"""Clocks: steps of the wall clock backwards, and the least round trip of late."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.session import stored
from lignum.sources.relations import change_log, seq_times, with_views

#: Two clocks aren't read at once: so much less is no step.
JITTER_NS = 1_000_000


def carried(parts: DataFrame, order: str, end_of: Callable[[pd.DataFrame, int | None], int | None]) -> dict[int, int | None]:
    """What each range of stored ``parts`` (with ``_part``) begins with, where a value is carried along ``order``.

    ``end_of`` takes a range's rows and what it begins with. At first all begin with nothing; a range is done again
    while what it begins with changes, which is a few rounds where values soon don't depend on the start, and no
    more than there are ranges. The driver holds a number a range.
    """
    spark = parts.sparkSession

    def run(part: pd.DataFrame) -> pd.DataFrame:
        start = part["_start"].iloc[0]
        end = end_of(part.sort_values(order), None if start is None or start == "" else int(start))
        return pd.DataFrame({"_part": [part["_part"].iloc[0]], "_end": ["" if end is None else str(end)]})

    starts = {r["_part"]: None for r in parts.select("_part").distinct().orderBy("_part").collect()}
    again, last = dict(starts), {}
    while again:
        known = spark.createDataFrame([(p, "" if t is None else str(t)) for p, t in again.items()], "_part int, _start string")
        found = parts.join(F.broadcast(known), "_part").groupBy("_part").applyInPandas(run, "_part int, _end string").collect()
        last |= {r["_part"]: int(r["_end"]) if r["_end"] else None for r in found}
        again, before = {}, None
        for p in starts:
            if starts[p] != before:
                starts[p] = again[p] = before
            before = last[p]
    return starts


def _steps(offsets: np.ndarray, start: int | None, jitter: int) -> tuple[np.ndarray, int | None]:
    """How far the clock stepped back at each sample, and the offset that then counts."""
    back, held = np.zeros(len(offsets), dtype=np.int64), start
    for i, off in enumerate(offsets.tolist()):
        if held is not None and off < held - jitter:
            back[i] = held - off
            held = off
        elif held is None or off > held:
            held = off
    return back, held


def stepped_back(samples: DataFrame, now_ns: int | None = None, jitter_ns: int = JITTER_NS) -> DataFrame:
    """``seq, wall_ns`` of samples ``seq, wall_ns, mono_ns``, where every later step back of the wall clock has been taken off.

    The clock is compared with one that never steps. A step is counted when the difference falls by more than
    ``jitter_ns`` below the one that counts; that is the greatest since the last step. What is later than ``now_ns`` is
    dropped then. Samples without a number or a time are left out; ``seq`` tells them apart.
    """
    some = samples.select("seq", "wall_ns", "mono_ns").dropna()
    parts = stored(some.repartitionByRange("seq").withColumn("_part", F.spark_partition_id()), "clock")
    starts = carried(parts, "seq", lambda rows, start: _steps((rows["wall_ns"] - rows["mono_ns"]).to_numpy(np.int64), start, jitter_ns)[1])
    spark = samples.sparkSession
    known = spark.createDataFrame([(p, None if t is None else str(t)) for p, t in starts.items()], "_part int, _start string")

    def marked(part: pd.DataFrame) -> pd.DataFrame:
        part, start = part.sort_values("seq"), part["_start"].iloc[0]
        part["back"] = _steps((part["wall_ns"] - part["mono_ns"]).to_numpy(np.int64), None if start is None else int(start), jitter_ns)[0]
        return part[["_part", "seq", "wall_ns", "back"]]

    rows = stored(parts.join(F.broadcast(known), "_part").groupBy("_part").applyInPandas(marked, "_part int, seq long, wall_ns long, back long"), "clock")
    own = rows.groupBy("_part").agg(F.sum("back").alias("own"))  # a row for each range
    after = own.select("_part", F.coalesce(F.sum("own").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("after"))
    later = Window.partitionBy("_part").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("later", F.coalesce(F.sum("back").over(later), F.lit(0))).join(F.broadcast(after), "_part")
    out = out.select("seq", (F.col("wall_ns") - F.col("later") - F.col("after")).alias("wall_ns"))
    return out if now_ns is None else out.filter(F.col("wall_ns") <= now_ns)


def least_rtt(samples: DataFrame, lifetime_ns: int) -> DataFrame:
    """Adds ``least`` to ``link, at_ns, rtt``: the least of a link's last ``lifetime_ns``, its own included; null where all are null.

    Time is cut into pieces of one lifetime. What a row looks back on is its own piece up to itself and the end of the
    piece before: the least of the first runs on in order of time, that of the second runs against it, where the row
    is asked for as of one lifetime earlier. Each row is looked at twice, however many share a lifetime.
    """
    at = F.col("at_ns").cast("long")
    piece = F.expr(f"(cast(at_ns AS long) - pmod(cast(at_ns AS long), {lifetime_ns}L)) div {lifetime_ns}L")
    onward = Window.partitionBy("link", "_piece").orderBy("at_ns").rangeBetween(Window.unboundedPreceding, 0)
    rows = samples.withColumn("_piece", piece).withColumn("_own", F.min("rtt").over(onward))
    both = F.array(F.struct(F.col("_piece").alias("piece"), at.alias("key"), F.lit(0).alias("asks")), F.struct((F.col("_piece") - 1).alias("piece"), (at - lifetime_ns).alias("key"), F.lit(1).alias("asks")))
    back = Window.partitionBy("link", "_of.piece").orderBy(F.desc("_of.key"), "_of.asks").rowsBetween(Window.unboundedPreceding, 0)
    led = rows.withColumn("_of", F.explode(both)).withColumn("_before", F.min(F.when(F.col("_of.asks") == 0, F.col("rtt"))).over(back))
    return led.filter("_of.asks = 1").withColumn("least", F.least("_own", "_before")).select(*samples.columns, "least")


def fingerprint(born_ns) -> F.Column:
    """A 64-bit fingerprint of a birth time, 0 for an unknown one; equal times have equal ones."""
    return F.when(born_ns.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(born_ns))


HOUR = 3_600_000_000_000


def _samples(s: SparkSession, d: str) -> DataFrame:
    t, k = seq_times(s, d), F.col("seq")
    drift = F.floor(k / 700) * 3_000_000_000 - F.floor(k / 1100) * 2_000_000_000 + (k % 3) * 400_000
    return t.select("seq", "wall_ns", (F.col("wall_ns") + drift).cast("long").alias("mono_ns"))


def _rtts(s: SparkSession, d: str) -> DataFrame:
    return change_log(s, d).select("seq", (F.col("id") % 3).alias("link"), F.col("wall_ns").alias("at_ns"), F.col("content").alias("rtt"))


QUERIES = {"stepped_clock": lambda s, d: stepped_back(_samples(s, d)), "least_rtt": lambda s, d: least_rtt(_rtts(s, d), 5 * HOUR)}
ORACLE_SQL = {
    "stepped_clock": with_views(
        """, o AS MATERIALIZED (SELECT seq, wall_ns, -(seq // 700 * 3000000000 - seq // 1100 * 2000000000 + seq % 3 * 400000) AS off, row_number() OVER (ORDER BY seq) AS k FROM seq_times),
f AS (SELECT seq, wall_ns, k, off AS held, CAST(0 AS BIGINT) AS back FROM o WHERE k = 1
  UNION ALL SELECT o.seq, o.wall_ns, o.k, CASE WHEN o.off > f.held OR o.off < f.held - 1000000 THEN o.off ELSE f.held END, CASE WHEN o.off < f.held - 1000000 THEN f.held - o.off ELSE 0 END FROM f JOIN o ON o.k = f.k + 1)
SELECT seq, CAST(wall_ns - coalesce(sum(back) OVER (ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS wall_ns FROM f""", "change_log", "seq_times"
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "least_rtt": with_views(
        f", r AS (SELECT seq, id % 3 AS link, wall_ns AS at_ns, content AS rtt FROM change_log) SELECT *, min(rtt) OVER (PARTITION BY link ORDER BY at_ns RANGE BETWEEN {5 * HOUR} PRECEDING AND CURRENT ROW) AS least FROM r", "change_log"
    ),
}
ORACLE_SQL = {k: q.replace(")\n, ", "),\n") for k, q in ORACLE_SQL.items()}
