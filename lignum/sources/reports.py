"""Reports of benchmark runs as JSON: one document a link and system, with its measurements within; broken ones are told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.session import shared_folder
from lignum.sources.relations import measurements, with_views

VERSION = 1
MEASUREMENT = "id string, metric string, value double, unit string, better string, target string, pass boolean, status string, detail string, samples long"
REPORT = f"version int, profile string, system string, measurements array<struct<{MEASUREMENT.replace(' ', ': ').replace(',: ', ', ')}>>"
#: What a measurement's status and direction can be.
STATUSES, DIRECTIONS = ("ok", "unavailable", "skipped", "timeout", "error"), ("lower", "higher")
FIELDS = [f.split()[0] for f in MEASUREMENT.split(", ")]


def write_reports(m: DataFrame, path: str) -> None:
    """Measurements (``profile, system`` and the fields of ``MEASUREMENT``; those that lack are null) as reports, a line each.

    A report has the measurements of one link and system, which are some dozens.
    """
    fields = dict(f.split() for f in MEASUREMENT.split(", "))
    one = F.struct(*[(F.col(c) if c in m.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])
    found = m.groupBy("profile", "system").agg(F.sort_array(F.collect_list(one)).alias("measurements"))
    found.select(F.lit(VERSION).alias("version"), "profile", "system", "measurements").write.option("ignoreNullFields", "false").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row for each measurement: ``profile, system``, its fields, and ``reason``, which is null where all is well.

    A line that is no JSON object of the stated types is one row with the reason ``not a report`` and the line in ``raw``; a report of
    another version, or without a link or system, one with ``unknown version`` or ``no profile``; measurements without id or metric, of
    a status or direction that isn't known, or ``ok`` without a value, are rows with a reason each. Fields beyond the stated ones
    are ignored; a report without measurements gives none.
    """
    raw = spark.read.schema(REPORT + ", raw string").option("columnNameOfCorruptRecord", "raw").option("mode", "PERMISSIVE").json(path)
    whole = F.when(F.col("raw").isNotNull(), "not a report").when(~F.col("version").eqNullSafe(F.lit(VERSION)), "unknown version").when(F.col("profile").isNull() | F.col("system").isNull(), "no profile")
    raw = raw.withColumn("bad", whole)
    empty = F.array(F.lit(None).cast(REPORT.split("array<", 1)[1][:-1]))
    rows = raw.select("profile", "system", "raw", "bad", F.explode(F.when(F.col("bad").isNotNull(), empty).otherwise(F.coalesce("measurements", F.array().cast(REPORT.split("measurements ", 1)[1])))).alias("m"))
    rows = rows.select("profile", "system", *[F.col("m")[c].alias(c) for c in FIELDS], "bad", "raw")
    own = (
        F.when(F.col("id").isNull() | F.col("metric").isNull(), "no id")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status")
        .when(~F.coalesce(F.col("better").isin(*DIRECTIONS), F.lit(False)), "unknown direction")
        .when((F.col("status") == "ok") & F.col("value").isNull(), "ok without a value")
    )
    return rows.withColumn("reason", F.coalesce("bad", own)).drop("bad")


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "reports")
    write_reports(measurements(s, d), path)
    return read_reports(s, path).select("profile", "system", "id", "metric", "value", "unit", "better", "status", "samples", "reason")


def _broken(s: SparkSession, d: str) -> DataFrame:
    """Reports made of orders' fields, of which most are broken in one way or another."""
    from lignum.sources.relations import read

    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "lost").otherwise("ok")
    one = F.format_string('{"id": %s, "metric": "m", "value": %s, "better": "lower", "status": "%s", "samples": 3}', F.when(k % 5 == 0, "null").otherwise('"T1"'), F.when(k % 11 == 0, "null").otherwise(F.format_string("%.2f", "o_totalprice")), status)
    text = F.format_string('{"version": %s, "profile": "p", "system": %s, "measurements": [%s]}', F.when(k % 13 == 0, "2").otherwise("1"), F.when(k % 17 == 0, "null").otherwise('"own"'), one)
    line = F.when(k % 19 == 0, F.substring(text, 1, 40)).when(k % 23 == 0, F.regexp_replace(text, '"samples": 3', '"samples": "x"')).otherwise(text)
    path = shared_folder(s, "broken")
    read(s, d, "orders").select(line.alias("value")).write.text(path)
    return read_reports(s, path).groupBy(F.coalesce("reason", F.lit("well")).alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {"report_round_trip": _round_trip, "broken_reports": _broken}
ORACLE_SQL = {
    "report_round_trip": with_views("SELECT profile, system, id, metric, value, unit, better, status, samples, CASE WHEN status = 'ok' AND value IS NULL THEN 'ok without a value' END AS reason FROM measurements", "measurements"),
    "broken_reports": """SELECT CASE WHEN k % 19 = 0 OR k % 23 = 0 THEN 'not a report' WHEN k % 13 = 0 THEN 'unknown version' WHEN k % 17 = 0 THEN 'no profile' WHEN k % 5 = 0 THEN 'no id'
  WHEN k % 7 = 0 THEN 'unknown status' WHEN k % 11 = 0 THEN 'ok without a value' ELSE 'well' END AS reason, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1""",
}
