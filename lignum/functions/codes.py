"""Keys of operations, times as numbers, plain display names, links that a move changes, tables of scorecards."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lignum.functions.names import MARKER, marked
from lignum.functions.rules import link_shown
from lignum.operators.tree import paths
from lignum.sources.relations import change_log, items, read, with_views

SECOND = 1_000_000_000
MOST_NS, LEAST_NS = 2**63 - 1, -(2**63)


@F.pandas_udf(StringType())
def lower_key(names: pd.Series) -> pd.Series:
    """Names that differ by simple case or composition only have the same key: decomposed, lower-cased, decomposed."""
    nfd = lambda x: unicodedata.normalize("NFD", x)
    return names.map(lambda x: None if x is None else nfd(nfd(x).lower()))


def plain_display_names(names: DataFrame) -> DataFrame:
    """``parent, name, display``: of a folder's distinct names with one key, the first in byte order stays, others are numbered from 2, taken or not."""
    keyed = names.select("parent", "name").distinct().withColumn("key", lower_key("name"))
    n = F.row_number().over(Window.partitionBy("parent", "key").orderBy("name"))
    return keyed.withColumn("n", n).select("parent", "name", F.when(F.col("n") == 1, F.col("name")).otherwise(marked(F.col("name"), F.col("n"))).alias("display"))


def op_hash(kind: str, *parts: Column) -> Column:
    """A key of an operation; each part goes with its length, so that parts don't run together. Null parts count as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    framed = [x for t in texts for x in (F.lpad(F.hex(F.octet_length(t).cast("long")), 8, "0"), t)]
    return F.sha2(F.concat(F.lit(kind), *framed).cast("binary"), 256)


def seconds_of(ns: Column) -> Column:
    """Nanoseconds since 1970 as seconds in double precision."""
    return F.call_function("div", ns, F.lit(SECOND)).cast("double") + (ns % SECOND) / F.lit(1e9)


def ns_of(seconds: Column) -> Column:
    """Seconds as nanoseconds, held to the range of 64 bits; 0 for what isn't a number."""
    whole = F.floor(seconds)
    near = whole * SECOND + F.round((seconds - whole) * 1e9).cast("long")
    return F.when(F.isnan(seconds), F.lit(0).cast("long")).when(seconds >= MOST_NS / 1e9, F.lit(MOST_NS)).when(seconds <= LEAST_NS / 1e9, F.lit(LEAST_NS)).otherwise(near)


def link_flips(tree: DataFrame, folder: str, deeper: int, root: Column) -> DataFrame:
    """``id`` of the links below ``folder`` whose view changed as it moved ``deeper`` levels down.

    ``tree`` has ``id, kind, path, depth, target`` after the move; an untouched target may leave the root at one depth and not at another.
    """
    below = tree.filter(F.col("path").startswith(folder + "/") & (F.col("kind") == "Symlink"))
    now = F.col("depth") - 1
    view = lambda depth: link_shown(F.coalesce("target", F.lit("")), depth.cast("int"), root)
    return below.filter(~view(now).eqNullSafe(view(F.greatest(now - deeper, F.lit(0))))).select("id")


def scorecard_rows(texts: DataFrame) -> DataFrame:
    """``id, profile, target, metric, own, sshfs, local, pass, ratio`` of the table rows below each ``## profile`` heading of a text."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    heading = F.when(F.col("line").startswith("## "), F.substr("line", F.lit(4)))
    lines = lines.withColumn("profile", F.last(heading, ignorenulls=True).over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    cells = lines.withColumn("c", F.transform(F.split("line", r"\|", -1), lambda x: F.trim(x))).filter("profile IS NOT NULL AND size(c) >= 11")
    named = {"target": 1, "metric": 2, "own": 4, "sshfs": 5, "local": 6, "pass": 9, "ratio": 10}
    return cells.filter(F.get("c", F.lit(1)).rlike("^T[0-9]+$")).select("id", "profile", *[F.get("c", F.lit(i)).alias(n) for n, i in named.items()])


def _linked(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 4
    target = F.when(k == 0, "../../../x").when(k == 1, "/srv/data/a").when(k == 2, "../x").otherwise("/etc/x")
    return paths(items(s, d)).select("id", "path", "depth", F.when(F.col("kind") == "File", "Symlink").otherwise("Dir").alias("kind"), target.alias("target"))


def _twins(s: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END")
    return read(s, d, "part").select((F.col("p_size") % 5).cast("long").alias("parent"), name.alias("name"))


def _cards(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    row = F.concat(F.lit("| T"), n, F.lit(" | open | ms | "), F.col("p_size").cast("string"), F.lit(" | 7 | 8 | x | y | yes | 2 |"))
    return read(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat(F.lit("| T0 | none\n## rtt"), n, F.lit("\n| ID | metric |\n"), row, F.lit("\n| no | "), row).alias("text"))


def version_key(text: Column) -> Column:
    """What orders versions ``[v]N.N...[-pre][+build]``: a struct to compare, null for anything else.

    Missing numbers are 0. A version with a pre-release comes before the one without; its identifiers, parted by dots, go one
    by one, numbers by value and before all others, and a list that ends first is less. Builds don't count.
    """
    parts = r"^v?([0-9]+(?:\.[0-9]+)*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    text = F.trim(text)
    numbers = F.regexp_replace(F.regexp_extract(text, parts, 1), r"(\.0+)+$", "")
    pre = F.regexp_extract(text, parts, 2)
    digits = lambda x: x.rlike("^[0-9]+$")
    one = lambda x: F.struct((~digits(x)).cast("int").alias("word"), F.when(digits(x), x.try_cast("decimal(38,0)")).alias("number"), F.when(~digits(x), x).alias("text"))
    ids = F.when(pre != "", F.transform(F.split(pre, r"\."), one)).otherwise(F.array().cast("array<struct<word:int,number:decimal(38,0),text:string>>"))
    return F.when(text.rlike(parts), F.struct(F.transform(F.split(numbers, r"\."), lambda x: x.try_cast("decimal(38,0)")).alias("numbers"), (pre == "").cast("int").alias("whole"), ids.alias("pre")))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as version ``a`` is before, like or after ``b``; null where either is no version."""
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).when(x.isNotNull() & y.isNotNull(), 0)


def _versions(s: SparkSession, d: str) -> DataFrame:
    k, j = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda k, j: F.concat(F.when(k % 3 == 0, "v").otherwise(""), (k % 2).cast("string"), F.lit("."), (j % 11).cast("string"), F.when(k % 5 == 0, ".0").when(k % 5 == 1, ".0.1").otherwise(""), F.when(j % 4 == 0, F.concat(F.lit("-rc."), (k % 12).cast("string"))).when(j % 4 == 1, "-beta").otherwise(""), F.when(k % 7 == 0, "+b7").when(k % 17 == 0, " x").otherwise(""))
    return read(s, d, "orders").select("o_orderkey", text(k, j).alias("a"), text(j, k).alias("b"))


QUERIES = {
    "version_orders": lambda s, d: _versions(s, d).select("o_orderkey", "a", "b", version_order(F.col("a"), F.col("b")).alias("order")),
    "display_names_plain": lambda s, d: plain_display_names(_twins(s, d)),
    "op_hashes": lambda s, d: items(s, d).select(
        "id", op_hash("create", F.col("parent"), F.col("name"), F.col("kind")).alias("create_op"), op_hash("modify", F.col("id"), F.col("content"), F.col("meta")).alias("modify_op"), op_hash("delete", F.col("id"), F.col("seq")).alias("delete_op")
    ),
    "times_coded": lambda s, d: change_log(s, d).select("seq", seconds_of(F.col("wall_ns")).alias("seconds"), ns_of(seconds_of(F.col("wall_ns"))).alias("ns")),
    "link_flips": lambda s, d: link_flips(_linked(s, d), "EUROPE", 1, F.lit("/srv/data")),
    "scorecard_rows": lambda s, d: scorecard_rows(_cards(s, d)),
}
_FRAME = "printf('%08X', strlen({0})) || {0}"


def _hash_sql(kind: str, *parts: str) -> str:
    framed = " || ".join(_FRAME.format(f"coalesce(CAST({p} AS VARCHAR), '')") for p in parts)
    return f"sha256('{kind}' || {framed})"


ORACLE_SQL = {
    "display_names_plain": f"""SELECT parent, name, CASE WHEN n = 1 THEN name ELSE name || ' ({MARKER} ' || n || ')' END AS display FROM (
SELECT *, row_number() OVER (PARTITION BY parent, lower(name) ORDER BY name) AS n FROM (SELECT DISTINCT CAST(p_size % 5 AS BIGINT) AS parent, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part))""",
    "op_hashes": with_views(f"SELECT id, {_hash_sql('create', 'parent', 'name', 'kind')} AS create_op, {_hash_sql('modify', 'id', 'content', 'meta')} AS modify_op, {_hash_sql('delete', 'id', 'seq')} AS delete_op FROM items", "items"),
    "times_coded": with_views(
        """SELECT seq, s AS seconds, CAST(floor(s) AS BIGINT) * 1000000000 + CAST(round((s - floor(s)) * 1e9) AS BIGINT) AS ns
FROM (SELECT seq, CAST(wall_ns // 1000000000 AS DOUBLE) + CAST(wall_ns % 1000000000 AS DOUBLE) / 1e9 AS s FROM change_log)""", "change_log"
    ),
    "link_flips": with_views("SELECT id FROM paths WHERE path LIKE 'EUROPE/%' AND kind = 'File' AND id % 4 IN (0, 1)", "items", "paths"),
    "scorecard_rows": """SELECT CAST(p_partkey AS BIGINT) AS id, 'rtt' || p_partkey AS profile, 'T' || p_partkey AS target, 'open' AS metric, CAST(p_size AS VARCHAR) AS own, '7' AS sshfs, '8' AS local, 'yes' AS pass, '2' AS ratio FROM part""",
}
_V = "CASE WHEN {0} % 3 = 0 THEN 'v' ELSE '' END || {0} % 2 || '.' || {1} % 11 || CASE {0} % 5 WHEN 0 THEN '.0' WHEN 1 THEN '.0.1' ELSE '' END || CASE {1} % 4 WHEN 0 THEN '-rc.' || {0} % 12 WHEN 1 THEN '-beta' ELSE '' END || CASE WHEN {0} % 7 = 0 THEN '+b7' WHEN {0} % 17 = 0 THEN ' x' ELSE '' END"
_W = "[{0} % 2, {1} % 11, 0, CASE {0} % 5 WHEN 1 THEN 1 ELSE 0 END, CASE WHEN {1} % 4 < 2 THEN 0 ELSE 1 END, CASE {1} % 4 WHEN 0 THEN 1 ELSE 0 END, CASE {1} % 4 WHEN 0 THEN {0} % 12 ELSE 0 END]"
ORACLE_SQL["version_orders"] = f"""SELECT o_orderkey, {_V.format("o_orderkey", "o_custkey")} AS a, {_V.format("o_custkey", "o_orderkey")} AS b, CASE WHEN (o_orderkey % 7 <> 0 AND o_orderkey % 17 = 0) OR (o_custkey % 7 <> 0 AND o_custkey % 17 = 0) THEN NULL
  WHEN {_W.format("o_orderkey", "o_custkey")} < {_W.format("o_custkey", "o_orderkey")} THEN -1 WHEN {_W.format("o_orderkey", "o_custkey")} > {_W.format("o_custkey", "o_orderkey")} THEN 1 ELSE 0 END AS "order" FROM orders"""
