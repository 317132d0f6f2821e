"""Listings by path and depth, entries too recent to trust, what is newer than a client has seen, texts of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.functions.names import fold_key
from lignum.operators.log import numbered
from lignum.operators.tree import paths
from lignum.sources.relations import LEVEL, items, read, with_views

#: Entries that changed within so long of the last observation may change again unseen.
RACY_NS = 20_000_000
#: The bytes of a packet on the wire, and the seconds of line rate that a queue holds beside the delay.
PACKET, BUFFER_S = 1514, 0.05


def children(tree: DataFrame, folder: str) -> DataFrame:
    """``path, name`` of what lies directly in ``folder`` ("" for the root), by the prefix of its path."""
    prefix = folder + "/" if folder else ""
    name = F.substring(F.col("path"), len(prefix) + 1, 1_000_000)
    return tree.filter(F.col("path").startswith(prefix)).select("path", name.alias("name")).filter("name <> '' AND NOT contains(name, '/')")


def by_depth(tree: DataFrame, *touched) -> DataFrame:
    """Items numbered from 1, parents before children, in order of ``touched`` within each depth."""
    return numbered(tree, "depth", *touched)


def published_order(changes: DataFrame, tree: DataFrame) -> DataFrame:
    """``id, op, at``: one batch's changes (``id, op, pos``) numbered from 1 as they go out: upserts before removals, parents before children, then by ``pos``.

    The depth is that of the item after the batch; what doesn't hang together with the root comes last among its like.
    """
    deep = paths(tree.select("id", "parent", "name")).select("id", "depth")
    rows = changes.join(deep, "id", "left").withColumn("last", (F.col("op") == "remove").cast("int"))
    return numbered(rows, F.asc("last"), F.asc_nulls_last("depth"), F.asc("pos"), F.asc("id")).select("id", "op", "at")


def racy(stats: DataFrame, observed_ns: int, window_ns: int = RACY_NS) -> DataFrame:
    """Entries that changed no earlier than ``window_ns`` before the last observation, or after it."""
    after = F.lit(observed_ns - window_ns)
    return stats.filter((F.col("mtime_ns") >= after) | (F.col("ctime_ns") >= after))


def new_versions(stats: DataFrame, observed_ns: int, window_ns: int = RACY_NS) -> DataFrame:
    """``id, content``: racy files get another content version; ``stats`` has ``id, kind, content, mtime_ns, ctime_ns``."""
    return racy(stats, observed_ns, window_ns).filter("kind = 'File'").select("id", (F.col("content") + 1).alias("content"))


def changed_after(ctime_ns: Column, mtime_ns: Column, seen_ns: Column) -> Column:
    """Whether an entry changed after what was seen; where the time seen is unknown nothing proves it older, so it did."""
    return F.coalesce((ctime_ns > seen_ns) | (mtime_ns > seen_ns), F.lit(True))


def newer(stats: DataFrame) -> DataFrame:
    """``id, newer, arrived``: entries that are newer than a client saw, or arrived in their place since.

    ``stats`` has ``id, kind, seq, meta, differs, ctime_ns, mtime_ns, seen_seq, seen_ns``. Indexed entries
    have a ``seq`` and go by it, unless a file ``differs`` from the index; others go by their times.
    """
    by_time = changed_after(F.col("ctime_ns"), F.col("mtime_ns"), F.col("seen_ns"))
    is_newer = (F.col("seq") > F.col("seen_seq")) | ((F.col("kind") != "Dir") & F.col("differs"))
    arrived = F.col("meta") > F.col("seen_seq")
    known = F.col("seq").isNotNull()
    return stats.select("id", F.when(known, is_newer).otherwise(by_time).alias("newer"), F.when(known, arrived).otherwise(by_time).alias("arrived"))


def fold_groups(names: DataFrame) -> DataFrame:
    """``parent, key, n``: how many names of a folder fold to each key."""
    return names.select("parent", fold_key("name").alias("key")).groupBy("parent", "key").agg(F.count("*").alias("n"))


def watch_counts(folders: DataFrame) -> DataFrame:
    """How many folders are watched and how many are polled, as watches ran out; one row."""
    return folders.agg(F.count_if(~F.col("polled")).alias("watched"), F.count_if("polled").alias("polled"))


def content_tag(text: Column) -> Column:
    """``tag, nonce`` of a first line ``tag#nonce``, or null; the nonce is an unsigned 64-bit number, kept as decimal text."""
    line = F.substring_index(text, "\n", 1)
    number = F.regexp_extract(line, "^[^#]*#\\+?([0-9]+)$", 1)
    value = number.try_cast("decimal(38,0)")
    fits = (number != "") & (value <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.when(fits, F.struct(F.substring_index(line, "#", 1).alias("tag"), value.cast("string").alias("nonce")))


def key_values(texts: DataFrame) -> DataFrame:
    """``id, key, value`` of the lines ``key=value`` of each text, trimmed; a key's last line counts, other lines are skipped."""
    lines = texts.select("id", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).filter(F.contains("line", F.lit("=")))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    key = trim(F.substring_index("line", "=", 1))
    value = trim(F.expr("substring(line, locate('=', line) + 1)"))
    return lines.select("id", key.alias("key"), "at", value.alias("value")).groupBy("id", "key").agg(F.max_by("value", "at").alias("value"))


def queue_limit(rtt_ms: Column, bytes_per_s: Column) -> Column:
    """Packets that one direction of a link queues: its delay and buffer at line rate, and half as many for the answers."""
    held = bytes_per_s * (rtt_ms / 2000 + BUFFER_S) / PACKET * 1.5
    return F.coalesce(F.ceil(held) + 64, F.lit(100_000))


def _stats(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id") % 1000
    return items(s, d).select(
        "id", "kind", "content", "mtime_ns", (F.col("mtime_ns") + n * 1000).alias("ctime_ns"), F.when(n % 4 != 0, F.col("seq")).alias("seq"), "meta",
        (n % 7 == 0).alias("differs"), (n * 9).alias("seen_seq"), F.when(n % 3 != 0, n * 2_000_000).alias("seen_ns"),
    )


def _texts(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    text = F.concat_ws("\n", F.concat("p_name", F.lit(" #"), p.cast("string")), F.concat(F.lit(" size = "), F.col("p_size").cast("string")), F.lit("none"), F.concat(F.lit("brand=a="), F.col("p_brand")), F.lit("size=last "))
    tagged = F.when(p % 3 == 0, F.concat("p_name", F.lit("#"), p.cast("string"), F.lit("99999999999999999\nmore#1"))).when(p % 3 == 1, F.concat(F.lit("x#+0"), p.cast("string"))).otherwise("no number#")
    return read(s, d, "part").select(p.cast("long").alias("id"), text.alias("text"), tagged.alias("tagged"))


def _links(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(s, d, "part").select(p.cast("long").alias("id"), (p % 200).alias("rtt_ms"), F.when(p % 3 != 0, F.col("p_size").cast("long") * 125_000).alias("rate"))


_STATS = """stats AS (SELECT id, kind, content, mtime_ns, mtime_ns + id % 1000 * 1000 AS ctime_ns, CASE WHEN id % 1000 % 4 <> 0 THEN seq END AS seq, meta,
  id % 1000 % 7 = 0 AS differs, id % 1000 * 9 AS seen_seq, CASE WHEN id % 1000 % 3 <> 0 THEN id % 1000 * 2000000 END AS seen_ns FROM items)"""
_BY_TIME = "coalesce(ctime_ns > seen_ns OR mtime_ns > seen_ns, true)"
OBSERVED = 500_000_000
def _batch(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).filter("id % 3 = 0").select("id", F.when(F.col("id") % 5 == 0, "remove").otherwise("upsert").alias("op"), (F.col("id") * 7919 % 100_003).alias("pos"))


QUERIES = {
    "published_order": lambda s, d: published_order(_batch(s, d), items(s, d)),
    "children_by_path": lambda s, d: children(paths(items(s, d)), "EUROPE"),
    "children_of_root": lambda s, d: children(paths(items(s, d)), ""),
    "ordered_by_depth": lambda s, d: by_depth(paths(items(s, d)).select("id", "depth", "seq"), "seq", "id").select("id", F.col("depth").cast("int").alias("depth"), "at"),
    "racy_entries": lambda s, d: racy(_stats(s, d), OBSERVED).select("id"),
    "racy_versions": lambda s, d: new_versions(_stats(s, d), OBSERVED),
    "newer_than_seen": lambda s, d: newer(_stats(s, d)),
    "fold_groups": lambda s, d: fold_groups(read(s, d, "part").select((F.col("p_size") % 5).cast("long").alias("parent"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END").alias("name"))),
    "watch_counts": lambda s, d: watch_counts(items(s, d).filter("kind = 'Dir'").select((F.col("id") % 11 > 7).alias("polled"))),
    "content_tags": lambda s, d: _texts(s, d).select("id", content_tag(F.col("tagged")).alias("x")).select("id", "x.tag", "x.nonce"),
    "key_values": lambda s, d: key_values(_texts(s, d)),
    "queue_limits": lambda s, d: _links(s, d).select("id", queue_limit(F.col("rtt_ms"), F.col("rate")).cast("long").alias("packets")),
}
ORACLE_SQL = {
    "children_by_path": with_views("SELECT path, own AS name FROM paths WHERE path LIKE 'EUROPE/%' AND depth = 2", "items", "paths"),
    "children_of_root": with_views("SELECT path, own AS name FROM paths WHERE depth = 1", "items", "paths"),
    "ordered_by_depth": with_views("SELECT id, depth, row_number() OVER (ORDER BY depth, seq, id) AS at FROM paths", "items", "paths"),
    "racy_entries": with_views(f", {_STATS} SELECT id FROM stats WHERE greatest(mtime_ns, ctime_ns) >= {OBSERVED - RACY_NS}", "items"),
    "racy_versions": with_views(f", {_STATS} SELECT id, content + 1 AS content FROM stats WHERE kind = 'File' AND greatest(mtime_ns, ctime_ns) >= {OBSERVED - RACY_NS}", "items"),
    "newer_than_seen": with_views(
        f", {_STATS} SELECT id, CASE WHEN seq IS NULL THEN {_BY_TIME} ELSE seq > seen_seq OR kind = 'File' AND differs END AS newer, CASE WHEN seq IS NULL THEN {_BY_TIME} ELSE meta > seen_seq END AS arrived FROM stats", "items"
    ),
    "fold_groups": "SELECT CAST(p_size % 5 AS BIGINT) AS parent, lower(p_name) AS key, count(*) AS n FROM part GROUP BY 1, 2",
    "watch_counts": with_views("SELECT count(*) FILTER (WHERE id % 11 <= 7) AS watched, count(*) FILTER (WHERE id % 11 > 7) AS polled FROM items WHERE kind = 'Dir'", "items"),
    "content_tags": """SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN v <= 18446744073709551615 THEN p_name END WHEN 1 THEN 'x' END AS tag,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN v <= 18446744073709551615 THEN CAST(v AS VARCHAR) END WHEN 1 THEN CAST(p_partkey AS VARCHAR) END AS nonce
FROM (SELECT *, CAST(p_partkey AS HUGEINT) * 100000000000000000 + 99999999999999999 AS v FROM part)""",
    "key_values": "SELECT CAST(p_partkey AS BIGINT) AS id, 'size' AS key, 'last' AS value FROM part UNION ALL SELECT p_partkey, 'brand', 'a=' || p_brand FROM part",
    "queue_limits": f"SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_partkey % 3 = 0 THEN 100000 ELSE CAST(ceil(CAST(p_size AS DOUBLE) * 125000 * (CAST(p_partkey % 200 AS DOUBLE) / 2000 + 0.05::DOUBLE) / {PACKET} * 1.5::DOUBLE) AS BIGINT) + 64 END AS packets FROM part",
}
ORACLE_SQL = {k: q.replace(")\n, ", "),\n") for k, q in ORACLE_SQL.items()}
ORACLE_SQL["published_order"] = with_views(f"SELECT id, CASE WHEN id % 5 = 0 THEN 'remove' ELSE 'upsert' END AS op, row_number() OVER (ORDER BY id % 5 = 0, id // {LEVEL}, id * 7919 % 100003, id) AS at FROM items WHERE id % 3 = 0", "items")
