"""Consistency: two trees compared, writes that were lost, content found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.sources.relations import items, read, with_views


def compared(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ("kind", "size", "hash", "target", "mode")) -> DataFrame:
    """Paths that differ: missing on one side, or the first of the columns that differs."""
    left = a.select("path", F.lit(True).alias("in_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select("path", F.lit(True).alias("in_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    what = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra")
    for c in columns:
        what = what.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c)
    return left.join(right, "path", "full_outer").withColumn("what", what).filter("what IS NOT NULL").select("path", "what")


def lost_writes(written: DataFrame, present: DataFrame, excused: DataFrame) -> DataFrame:
    """Hashes that were written, are not present and have no excuse (overwritten or destroyed after being shown)."""
    return written.select("hash").distinct().join(present.select("hash"), "hash", "left_anti").join(excused.select("hash"), "hash", "left_anti")


def relocated(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where content is found again: each hash before with its first place after, or null."""
    found = after.groupBy("hash").agg(F.min("path").alias("found"))
    return before.select("hash", "path").join(found, "hash", "left").select("path", "found")


def _paths(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = items(s, d).filter("kind = 'File'").withColumns({"hash": F.sha2(F.col("content").cast("string"), 256), "target": F.when(F.col("id") % 3 == 0, F.col("name"))}).withColumn("path", F.concat(F.col("parent").cast("string"), F.lit("/"), "name"))
    other = t.filter("id % 19 <> 0").withColumn("size", F.when(F.col("id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("mode", F.when(F.col("id") % 5 == 0, F.lit(0)).otherwise(F.col("mode")))
    other = other.withColumn("hash", F.when(F.col("id") % 11 == 0, F.lit("x")).otherwise(F.col("hash"))).withColumn("target", F.when(F.col("id") % 13 == 0, F.lit("y")).otherwise(F.col("target")))
    return t.filter("id % 23 <> 0"), other


def _content(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash"), F.format_string("%06d", "doc_id").alias("path"))


QUERIES = {
    "trees_compared": lambda s, d: compared(*_paths(s, d)),
    "lost_writes": lambda s, d: lost_writes(_content(s, d), _content(s, d).filter("doc_id % 3 <> 0"), _content(s, d).filter("doc_id % 30 = 0")),
    "relocated": lambda s, d: relocated(_content(s, d).filter("doc_id % 2 = 0"), _content(s, d).filter("doc_id % 2 = 1")),
}
ORACLE_SQL = {
    "trees_compared": with_views(
        """SELECT CAST(parent AS VARCHAR) || '/' || name AS path, CASE WHEN id % 19 = 0 THEN 'missing' WHEN id % 23 = 0 THEN 'extra' WHEN id % 7 = 0 THEN 'size' WHEN id % 11 = 0 THEN 'hash' WHEN id % 13 = 0 THEN 'target' ELSE 'mode' END AS what FROM items
WHERE kind = 'File' AND NOT (id % 19 = 0 AND id % 23 = 0) AND (id % 19 = 0 OR id % 23 = 0 OR id % 7 = 0 OR id % 11 = 0 OR id % 13 = 0 OR id % 5 = 0)""", "items"
    ),
    "lost_writes": "WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL) SELECT DISTINCT hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE doc_id % 3 <> 0) AND hash NOT IN (SELECT hash FROM h WHERE doc_id % 30 = 0)",
    "relocated": "WITH h AS (SELECT doc_id, sha256(text) AS hash, printf('%06d', doc_id) AS path FROM documents WHERE text IS NOT NULL) SELECT a.path, (SELECT min(path) FROM h b WHERE b.hash = a.hash AND b.doc_id % 2 = 1) AS found FROM h a WHERE a.doc_id % 2 = 0",
}
