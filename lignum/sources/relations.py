"""The engine's tables, and how the supplied tables are seen as such.

``ITEMS`` and ``LOG`` are the schemas that operators take. The functions below view the supplied tables
in that form, and ``VIEWS`` says the same in SQL, so that results can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "id long, parent long, name string, kind string, size long, mtime_ns long, mode int, access int, content long, meta long, seq long"
LOG = "seq long, id long, op string, parent long, content long, wall_ns long"
ROOT = 1
LEVEL = 1_000_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ns(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * 1000


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: errors remove an item, all others upsert it into one of 16 folders."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long")
    remove = F.col("event_type") == "error"
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.col("user_id").alias("id"),
        F.when(remove, "remove").otherwise("upsert").alias("op"),
        F.when(~remove, k % 16).alias("parent"),
        F.when(~remove, k).alias("content"),
        epoch_ns(F.col("ts")).alias("wall_ns"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree: root, regions, nations, customers, orders."""
    at = lambda level, key: (F.col(key).cast("long") + level * LEVEL)

    def part(df, level, key, parent, name, kind, size, mode):
        return df.select(
            at(level, key).alias("id"), parent.alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), size.cast("long").alias("size"),
            (F.col(key).cast("long") * 1_000_003).alias("mtime_ns"), mode.cast("int").alias("mode"), F.pmod(F.col(key), F.lit(8)).cast("int").alias("access"),
            (F.col(key).cast("long") * 2 + level).alias("content"), (F.col(key).cast("long") * 3).alias("meta"), (F.col(key).cast("long") * 5 + level).alias("seq"),
        )

    zero = F.lit(0)
    root = spark.range(1).select(
        F.lit(ROOT).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit("").alias("name"), F.lit("Dir").alias("kind"), F.lit(0).cast("long").alias("size"),
        F.lit(0).cast("long").alias("mtime_ns"), F.lit(493).alias("mode"), F.lit(7).alias("access"), F.lit(0).cast("long").alias("content"), F.lit(0).cast("long").alias("meta"), F.lit(0).cast("long").alias("seq"),
    )
    region = part(read(spark, sf_dir, "region"), 1, "r_regionkey", F.lit(ROOT).cast("long"), F.col("r_name"), "Dir", zero, F.lit(493))
    nation = part(read(spark, sf_dir, "nation"), 2, "n_nationkey", at(1, "n_regionkey"), F.col("n_name"), "Dir", zero, F.lit(493))
    customer = part(read(spark, sf_dir, "customer"), 3, "c_custkey", at(2, "c_nationkey"), F.col("c_name"), "Dir", zero, F.lit(493))
    mode = F.lit(384) + F.pmod(F.col("o_orderkey"), F.lit(64))
    order = part(read(spark, sf_dir, "orders"), 4, "o_orderkey", at(3, "o_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(".txt")), "File", F.floor("o_totalprice"), mode)
    return root.unionByName(region).unionByName(nation).unionByName(customer).unionByName(order)


def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A working set over the tree: the root, all nations, and every fifth customer."""
    c = read(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select((F.col("c_custkey") + 3 * LEVEL).alias("id"))
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 2 * LEVEL).alias("id"))
    return c.union(n).union(spark.range(1).select(F.lit(ROOT).cast("long").alias("id")))


def folders_shown(spark: SparkSession) -> DataFrame:
    """A working set over the change log: four of its folders."""
    return spark.range(4).select("id")


def seq_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth sequence number with its time."""
    return change_log(spark, sf_dir).filter("seq % 50 = 0").select("seq", "wall_ns")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measurement for each part, system and link: line items as benchmark rows."""
    li = read(spark, sf_dir, "lineitem")
    m = li.groupBy(
        F.concat(F.lit("T"), (F.col("l_linenumber") + 0).cast("string")).alias("id"),
        F.when(F.col("l_suppkey") % 3 == 0, "own").when(F.col("l_suppkey") % 3 == 1, "sshfs").otherwise("local").alias("system"),
        F.when(F.col("l_partkey") % 2 == 0, "rtt40-bw50").otherwise("rtt0-bw200").alias("profile"),
    ).agg(F.max("l_extendedprice").alias("value"), F.count("*").alias("samples"), F.min("l_quantity").alias("low"))
    return m.select(
        "id", F.lit("wait_ms").alias("metric"), F.when(F.col("samples") % 7 != 0, F.col("value") / 1000).alias("value"),
        F.when(F.col("id") == "T3", "us").otherwise("ms").alias("unit"), F.when(F.col("id") == "T5", "higher").otherwise("lower").alias("better"),
        "system", "profile", F.when(F.col("samples") % 7 == 0, "skipped").when(F.col("samples") % 11 == 0, "timeout").otherwise("ok").alias("status"), "samples",
    )


#: The same in SQL.
VIEWS = {
    "change_log": """SELECT event_id + 1 AS seq, user_id AS id, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op,
  CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 16 END AS parent,
  CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS content, epoch_us(ts) * 1000 AS wall_ns FROM events""",
    "items": f"""SELECT CAST({ROOT} AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, '' AS name, 'Dir' AS kind, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime_ns,
  CAST(493 AS INTEGER) AS mode, CAST(7 AS INTEGER) AS access, CAST(0 AS BIGINT) AS content, CAST(0 AS BIGINT) AS meta, CAST(0 AS BIGINT) AS seq
UNION ALL SELECT r_regionkey + {LEVEL}, {ROOT}, r_name, 'Dir', 0, CAST(r_regionkey AS BIGINT) * 1000003, 493, r_regionkey % 8, CAST(r_regionkey AS BIGINT) * 2 + 1, CAST(r_regionkey AS BIGINT) * 3, CAST(r_regionkey AS BIGINT) * 5 + 1 FROM region
UNION ALL SELECT n_nationkey + 2 * {LEVEL}, n_regionkey + {LEVEL}, n_name, 'Dir', 0, CAST(n_nationkey AS BIGINT) * 1000003, 493, n_nationkey % 8, CAST(n_nationkey AS BIGINT) * 2 + 2, CAST(n_nationkey AS BIGINT) * 3, CAST(n_nationkey AS BIGINT) * 5 + 2 FROM nation
UNION ALL SELECT c_custkey + 3 * {LEVEL}, c_nationkey + 2 * {LEVEL}, c_name, 'Dir', 0, c_custkey * 1000003, 493, CAST(c_custkey % 8 AS INTEGER), c_custkey * 2 + 3, c_custkey * 3, c_custkey * 5 + 3 FROM customer
UNION ALL SELECT o_orderkey + 4 * {LEVEL}, o_custkey + 3 * {LEVEL}, 'order ' || CAST(o_orderkey AS VARCHAR) || '.txt', 'File', CAST(floor(o_totalprice) AS BIGINT), o_orderkey * 1000003,
  CAST(384 + o_orderkey % 64 AS INTEGER), CAST(o_orderkey % 8 AS INTEGER), o_orderkey * 2 + 4, o_orderkey * 3, o_orderkey * 5 + 4 FROM orders""",
    "materialized": f"""SELECT c_custkey + 3 * {LEVEL} AS id FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT n_nationkey + 2 * {LEVEL} FROM nation UNION ALL SELECT {ROOT}""",
    "folders_shown": "SELECT CAST(range AS BIGINT) AS id FROM range(4)",
    "seq_times": "SELECT seq, wall_ns FROM change_log WHERE seq % 50 = 0",
    "measurements": """SELECT id, 'wait_ms' AS metric, CASE WHEN samples % 7 <> 0 THEN value / 1000 END AS value, CASE WHEN id = 'T3' THEN 'us' ELSE 'ms' END AS unit,
  CASE WHEN id = 'T5' THEN 'higher' ELSE 'lower' END AS better, system, profile,
  CASE WHEN samples % 7 = 0 THEN 'skipped' WHEN samples % 11 = 0 THEN 'timeout' ELSE 'ok' END AS status, samples
FROM (SELECT 'T' || CAST(l_linenumber AS VARCHAR) AS id, CASE l_suppkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'sshfs' ELSE 'local' END AS system,
  CASE WHEN l_partkey % 2 = 0 THEN 'rtt40-bw50' ELSE 'rtt0-bw200' END AS profile, max(l_extendedprice) AS value, count(*) AS samples FROM lineitem GROUP BY 1, 2, 3)""",
    # The tree is as deep as its five levels.
    "paths": f"""SELECT i.id, i.parent, i.kind, i.size, i.seq, CAST(i.id // {LEVEL} AS INTEGER) AS depth, i.name AS own,
  CASE CAST(i.id // {LEVEL} AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN i.name WHEN 2 THEN p1.name || '/' || i.name
    WHEN 3 THEN p2.name || '/' || p1.name || '/' || i.name ELSE p3.name || '/' || p2.name || '/' || p1.name || '/' || i.name END AS path
FROM items i LEFT JOIN items p1 ON p1.id = i.parent LEFT JOIN items p2 ON p2.id = p1.parent LEFT JOIN items p3 ON p3.id = p2.parent""",
    "closure": """SELECT id, id AS ancestor, 0 AS distance FROM items
UNION ALL SELECT i.id, i.parent, 1 FROM items i WHERE i.parent IS NOT NULL
UNION ALL SELECT i.id, p1.parent, 2 FROM items i JOIN items p1 ON p1.id = i.parent WHERE p1.parent IS NOT NULL
UNION ALL SELECT i.id, p2.parent, 3 FROM items i JOIN items p1 ON p1.id = i.parent JOIN items p2 ON p2.id = p1.parent WHERE p2.parent IS NOT NULL
UNION ALL SELECT i.id, p3.parent, 4 FROM items i JOIN items p1 ON p1.id = i.parent JOIN items p2 ON p2.id = p1.parent JOIN items p3 ON p3.id = p2.parent WHERE p3.parent IS NOT NULL""",
}


def with_views(body: str, *views: str) -> str:
    """SQL with the named views before it, in order."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" + body
