"""Change logs as streams: folding into a table, duplicate ops, windows and sessions.

The supplied events are read as a file stream and run to their end, so each query's result can be
compared with SQL over the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.operators import log as logs
from lignum.session import shared_folder
from lignum.sources.relations import epoch_ns
from lignum.streaming.keyed import KeyedTable
from lignum.streaming.states import drained


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, as the table may be one file, which a stream takes by pattern only.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def folded(stream: DataFrame, guard=None) -> DataFrame:
    """A log stream folded to its end: the latest change of each item."""
    table = KeyedTable(stream.sparkSession, guard=guard)
    drained(stream, table.apply)
    return table.read()


def as_log(events: DataFrame) -> DataFrame:
    """Events as rows of a change log, for streams as for tables."""
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long")
    remove = F.col("event_type") == "error"
    return events.select(
        (F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("id"), F.when(remove, "remove").otherwise("upsert").alias("op"),
        F.when(~remove, k % 16).alias("parent"), F.when(~remove, k).alias("content"), epoch_ns(F.col("ts")).alias("wall_ns"),
    )


def once(stream: DataFrame, keys: list[str], at: str, keep: str) -> DataFrame:
    """Ops without their repeats, which may come as late as ``keep``."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, "once")
    unique = stream.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys).select(*keys)
    query = unique.writeStream.option("checkpointLocation", shared_folder(spark, "stream")).format("parquet").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(unique.schema).parquet(path)


def windowed(stream: DataFrame, window, value: str) -> DataFrame:
    """Counts and sums by a time window and type; the result replaces itself with each batch."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, "windows")
    counted = stream.withWatermark("at", "1 day").groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    drained(counted, lambda df, k: df.write.mode("overwrite").parquet(path), mode="complete")
    return spark.read.parquet(path)


def _timed(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).withColumn("at", F.col("ts").cast("timestamp"))


def _windows(s, d):
    return windowed(_timed(s, d), F.window("at", "1 day"), "value").select(F.unix_seconds("w.start").alias("day"), "event_type", "n", "total")


def _sessions(s, d):
    found = windowed(_timed(s, d), F.session_window("at", "20 minutes"), "value")
    return found.groupBy("event_type").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


QUERIES = {
    "stream_fold": lambda s, d: folded(as_log(event_stream(s, d))),
    "stream_once": lambda s, d: once(_timed(s, d).withColumn("op", F.pmod(F.col("event_id"), F.lit(700))), ["op"], "at", "60 days"),
    "stream_daily": _windows,
    "stream_sessions": _sessions,
}
ORACLE_SQL = {
    "stream_fold": logs.ORACLE_SQL["lww_fold"],
    "stream_once": "SELECT DISTINCT event_id % 700 AS op FROM events",
    "stream_daily": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """SELECT event_type, sum(fresh)::BIGINT AS sessions, count(*) AS n FROM (SELECT event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) GROUP BY 1""",
}
