"""Selections under a budget: prefetch, eviction, quotas, packing, rates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.session import stored
from lignum.sources.relations import change_log, items, read, with_views


def prefetched(files: DataFrame, budget: int, largest: int) -> DataFrame:
    """Small files of each folder, in order of names, until the next would go over the folder's budget."""
    w = Window.partitionBy("parent").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    return files.filter((F.col("kind") == "File") & (F.col("size") <= largest)).withColumn("sum", F.sum("size").over(w)).filter(F.col("sum") <= budget).select("id", "parent", "sum")


def evicted(cache: DataFrame, budget: int) -> DataFrame:
    """Entries to drop, least recently used first, until the whole fits; pinned ones stay.

    ``cache`` has ``id, size, used, pinned``. An entry goes if, without those used before it, the cache is
    still too large. Sums over ranges of ``used``, which are stored, are taken in parallel and then offset.
    """
    total = cache.agg(F.sum("size").alias("total"))
    free = stored(cache.filter("NOT pinned").repartitionByRange("used", "id").withColumn("part", F.spark_partition_id()), "evicted")
    inner = free.withColumn("older", F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("used", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = free.groupBy("part").agg(F.sum("size").alias("own"))
    before = parts.withColumn("before", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = inner.join(before.select("part", "before"), "part").join(total, how="cross")  # one row of totals
    return both.filter(F.col("total") - F.col("older") - F.col("before") > budget).select("id", "size")


def newest(rows: DataFrame, at: str, most: int) -> DataFrame:
    """The newest rows, as many as are kept."""
    return rows.orderBy(F.desc(at)).limit(most)


def packed(rows: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Adds ``frame``: rows of a key in order, each frame as full as it can be without going over ``most``; larger rows stand alone."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        frames, held, frame = [], 0, 0
        for n in pdf[size]:
            if held and held + n > most:
                held, frame = 0, frame + 1
            held += n
            frames.append(frame)
        return pdf.assign(frame=frames)

    return rows.groupBy(key).applyInPandas(fill, f"{', '.join(f'{c} {t}' for c, t in rows.dtypes)}, frame long")


def token_bucket(asks: DataFrame, key: str, at_ns: str, size: str, per_second: float, burst: float) -> DataFrame:
    """Adds ``granted``: each key's asks in order against a bucket that fills at a rate up to a burst."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at_ns)
        level, last, out = burst, None, []
        for at, n in zip(pdf[at_ns], pdf[size], strict=True):
            level = min(burst, level + (0 if last is None else (at - last) / 1e9 * per_second))
            last = at
            out.append(level >= n)
            level -= n if out[-1] else 0
        return pdf.assign(granted=out)

    return asks.groupBy(key).applyInPandas(take, f"{', '.join(f'{c} {t}' for c, t in asks.dtypes)}, granted boolean")


def _cache(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).filter("kind = 'File'").select("id", "size", (F.col("seq") * 7919 % 100_003).alias("used"), (F.col("id") % 10 == 0).alias("pinned"))


QUERIES = {
    "prefetched": lambda s, d: prefetched(items(s, d), 500_000, 300_000),
    "evicted": lambda s, d: evicted(_cache(s, d), 1_000_000_000),
    "cache_bytes": lambda s, d: _cache(s, d).agg(F.sum("size").alias("bytes")),
    "kept_ops": lambda s, d: newest(change_log(s, d).select("seq", "id"), "seq", 4096),
    "frames": lambda s, d: packed(read(s, d, "documents").select("doc_id", "source", F.col("n_chars").alias("bytes")), "source", "doc_id", "bytes", 60_000),
    "token_bucket": lambda s, d: token_bucket(change_log(s, d).select("id", "seq", "wall_ns", F.coalesce("content", F.lit(1)).alias("bytes")), "id", "wall_ns", "bytes", 0.001, 200.0),
}
_CACHE = ", cache AS (SELECT id, size, seq * 7919 % 100003 AS used, id % 10 = 0 AS pinned FROM items WHERE kind = 'File')"
ORACLE_SQL = {
    "prefetched": with_views(
        "SELECT id, parent, sum FROM (SELECT id, parent, CAST(sum(size) OVER (PARTITION BY parent ORDER BY name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sum FROM items WHERE kind = 'File' AND size <= 300000) WHERE sum <= 500000", "items"
    ),
    "evicted": with_views(
        _CACHE + " SELECT id, size FROM (SELECT id, size, coalesce(sum(size) OVER (ORDER BY used, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM cache WHERE NOT pinned) WHERE (SELECT sum(size) FROM cache) - older > 1000000000", "items"
    ),
    "cache_bytes": with_views(_CACHE + " SELECT CAST(sum(size) AS BIGINT) AS bytes FROM cache", "items"),
    "kept_ops": with_views("SELECT seq, id FROM change_log ORDER BY seq DESC LIMIT 4096", "change_log"),
}
ORACLE_SQL = {k: q.replace(")\n, ", "),\n") for k, q in ORACLE_SQL.items()}
