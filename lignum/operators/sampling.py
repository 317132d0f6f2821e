"""Samples at least so far apart: marks along a log, thinned lists of times, rates between marks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lignum.operators.log import as_of, numbered
from lignum.session import stored
from lignum.sources.relations import change_log, with_views


def _chain(times: np.ndarray, last: int | None, gap: int) -> list[int]:
    """Places of the times that are more than ``gap`` after the one taken before; the first, if none was."""
    highest, found, at = np.maximum.accumulate(times), [], 0
    while True:
        if last is not None:
            at = int(np.searchsorted(highest, last + gap, side="right"))
        if at >= len(times):
            return found
        found.append(at)
        last = int(times[at])


def spaced(rows: DataFrame, order: str, at: str, gap: int) -> DataFrame:
    """Adds ``kept``: whether a row's ``at`` is more than ``gap`` after that of the last kept row, in ``order``.

    The first row is kept. Rows without a time or place are left out; ``order`` must tell rows apart. Each
    range of the order is marked by itself, from the last kept time of the ranges before it. At first that
    is taken as unknown; ranges are done again until no such time changes. Chains from different starts
    soon meet, so that takes a few rounds; it can take no more than there are ranges.
    """
    some = rows.filter(F.col(order).isNotNull() & F.col(at).isNotNull())
    parts = stored(some.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "spaced")
    spark, names = rows.sparkSession, rows.columns

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        times, start = part[at].to_numpy(np.int64), part["_start"].iloc[0]
        last = None if pd.isna(start) else int(start)
        found = _chain(times, last, gap)
        return pd.DataFrame({"_part": [part["_part"].iloc[0]], "_end": [str(int(times[found[-1]]) if found else last)]})

    def marks(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        start = part["_start"].iloc[0]
        part["kept"] = False
        part.iloc[_chain(part[at].to_numpy(np.int64), None if pd.isna(start) else int(start), gap), part.columns.get_loc("kept")] = True
        return part[[*names, "kept"]]

    def begun(starts: dict) -> DataFrame:
        """The ranges named, each with the time that it begins with, as text; a row for each range is sent."""
        known = spark.createDataFrame([(p, None if t is None else str(t)) for p, t in starts.items()], "_part int, _start string")
        return parts.join(F.broadcast(known), "_part")

    starts = {r["_part"]: None for r in parts.select("_part").distinct().orderBy("_part").collect()}
    if not starts:
        return rows.withColumn("kept", F.lit(True)).limit(0)
    last, again = {}, dict(starts)
    while again:
        narrow = begun(again).select("_part", "_start", order, at)
        last |= {r["_part"]: int(r["_end"]) for r in narrow.groupBy("_part").applyInPandas(ends, "_part int, _end string").collect()}
        again, before = {}, None
        for p in starts:
            if starts[p] != before:
                starts[p] = again[p] = before
            before = last[p]
    return begun(starts).groupBy("_part").applyInPandas(marks, parts.drop("_part").withColumn("kept", F.lit(True)).schema)


def thinned(times: DataFrame, gap_ns: int = 1_000_000_000, most: int = 20_000) -> DataFrame:
    """``seq, wall_ns`` of samples more than ``gap_ns`` after the last one kept; whenever there are more than ``most``, every other stays.

    The list is halved first at ``most + 1`` samples, then after each further ``most / 2``. So a sample's
    place when it is first halved, and how many times it will be, follow from its number; it stays if its
    place divides by two that often. ``most`` is even.
    """
    kept = numbered(spaced(times.select("seq", "wall_ns"), "seq", "wall_ns", gap_ns).filter("kept").drop("kept"), "seq")
    total, half = kept.count(), most // 2
    halvings = 0 if total <= most else 1 + (total - most - 1) // half
    k = F.col("at") - 1
    late = F.floor((k - most - 1) / half)
    batch = F.when(k <= most, 0).otherwise(late + 1)
    place = F.when(k <= most, k).otherwise(half + 1 + (k - most - 1) - late * half)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.lit(halvings) - batch, F.lit(62)).cast("int"))
    return kept.filter(F.pmod(place, step) == 0).select("seq", "wall_ns")


def rate_slices(log: DataFrame, width_ns: int = 100_000_000, idle_ns: int = 500_000_000) -> DataFrame:
    """``start_ns, bytes, elapsed_ns, rate, best``: bytes a second of each slice, and the best of the last ten.

    A slice ends with the first delivery at least ``width_ns`` after its start, where the next one starts;
    the first starts with the first delivery, whose bytes are in none. Slices that took more than
    ``idle_ns`` say nothing of the rate and are left out, as is one that has not ended.
    ``log`` has ``seq, wall_ns, bytes``.
    """
    rows = stored(spaced(numbered(log.select("seq", "wall_ns", "bytes"), "seq"), "at", "wall_ns", width_ns - 1), "rates")
    marks = rows.filter("kept").select(F.col("at").alias("mark"), F.struct("at", "wall_ns").alias("start"))
    within = as_of(rows.select("at", "wall_ns", "bytes", "kept", (F.col("at") - 1).alias("before")), marks, "before", "mark", "start").filter("start IS NOT NULL")
    slices = within.groupBy("start").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.max_by("wall_ns", "at").alias("end"), F.max_by("kept", "at").alias("whole")).filter("whole")
    slices = slices.select(F.col("start.wall_ns").alias("start_ns"), "bytes", (F.col("end") - F.col("start.wall_ns")).alias("elapsed_ns")).filter(F.col("elapsed_ns") <= idle_ns)
    slices = slices.withColumn("rate", F.col("bytes") * F.lit(1e9) / F.col("elapsed_ns"))
    # Blocks of slices in order, each led by the nine before it.
    block = F.floor((F.col("at") - 1) / 10_000)
    led = numbered(slices, "start_ns").select("*", F.explode(F.array_distinct(F.array(block, F.floor((F.col("at") + 8) / 10_000)))).alias("block"), block.alias("own"))
    recent = Window.partitionBy("block").orderBy("at").rowsBetween(-9, 0)
    return led.withColumn("best", F.max("rate").over(recent)).filter("block = own").select("start_ns", "bytes", "elapsed_ns", "rate", "best")


def _chain_sql(gap: int) -> str:
    """``chain``: rows more than ``gap`` after the one before in it, from the first; the log is in order of time."""
    return f"""WITH RECURSIVE firsts AS MATERIALIZED (SELECT wall_ns AS w, min(seq) AS s FROM change_log GROUP BY 1),
follow AS MATERIALIZED (SELECT c.seq, c.wall_ns, f.s AS after FROM change_log c ASOF LEFT JOIN firsts f ON c.wall_ns + {gap} < f.w),
chain AS (SELECT * FROM follow WHERE seq = (SELECT min(seq) FROM change_log) UNION ALL SELECT f.* FROM chain c JOIN follow f ON f.seq = c.after)"""


GAP, MOST, WIDTH, IDLE = 240_000_000_000, 2000, 600_000_000_000, 900_000_000_000
QUERIES = {
    "seq_times_thinned": lambda s, d: thinned(change_log(s, d), GAP, MOST),
    "rate_slices": lambda s, d: rate_slices(change_log(s, d).withColumn("bytes", F.col("content")), WIDTH, IDLE),
}
ORACLE_SQL = {
    "seq_times_thinned": with_views(
        f"""SELECT seq, wall_ns FROM ({_chain_sql(GAP)},
halved AS (SELECT seq, wall_ns, k, CASE WHEN k <= {MOST} THEN 0 ELSE 1 + (k - {MOST + 1}) // {MOST // 2} END AS batch,
  CASE WHEN k <= {MOST} THEN k ELSE {MOST // 2 + 1} + (k - {MOST + 1}) % {MOST // 2} END AS place,
  CASE WHEN n <= {MOST} THEN 0 ELSE 1 + (n - {MOST + 1}) // {MOST // 2} END AS halvings
  FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS k, count(*) OVER () AS n FROM chain))
SELECT * FROM halved WHERE place % (CAST(1 AS BIGINT) << CAST(least(halvings - batch, 62) AS INTEGER)) = 0)""", "change_log"
    ),
    "rate_slices": with_views(
        f"""SELECT start_ns, bytes, elapsed_ns, rate, max(rate) OVER (ORDER BY start_ns ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS best FROM ({_chain_sql(WIDTH - 1)},
spans AS (SELECT seq AS low, wall_ns AS start_ns, lead(seq) OVER (ORDER BY seq) AS high, lead(wall_ns) OVER (ORDER BY seq) AS end_ns FROM chain),
filled AS (SELECT start_ns, end_ns - start_ns AS elapsed_ns, CAST(sum(coalesce(content, 0)) AS BIGINT) AS bytes FROM spans JOIN change_log c ON c.seq > low AND c.seq <= high GROUP BY 1, 2)
SELECT *, CAST(bytes AS DOUBLE) * 1e9 / CAST(elapsed_ns AS DOUBLE) AS rate FROM filled WHERE elapsed_ns <= {IDLE})""", "change_log"
    ),
}
