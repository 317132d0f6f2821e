"""Change logs: last-writer-wins folds, differences, resuming, tombstones and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.session import stored
from lignum.sources.relations import VIEWS, change_log, folders_shown, seq_times


def order():
    """The order of changes: at equal sequence numbers a removal beats an upsert."""
    return F.struct("seq", (F.col("op") == "remove").cast("int").alias("is_remove"))


def fold(log: DataFrame) -> DataFrame:
    """The latest change of each item: ``id, seq, op, parent, content``."""
    return log.groupBy("id").agg(F.max_by(F.struct("seq", "op", "parent", "content"), order()).alias("last")).select("id", "last.*")


def live(log: DataFrame) -> DataFrame:
    """Items whose latest change isn't a removal."""
    return fold(log).filter("op = 'upsert'").drop("op")


def tombstones(log: DataFrame) -> DataFrame:
    """Removed items with the folder they were last in: ``id, seq, old_parent, wall_ns``."""
    last = log.groupBy("id").agg(
        F.max_by(F.struct("seq", "op", "wall_ns"), order()).alias("last"),
        F.max_by("parent", F.when(F.col("op") == "upsert", F.col("seq"))).alias("old_parent"),
    )
    return last.filter("last.op = 'remove'").select("id", "last.seq", "old_parent", "last.wall_ns")


def moves(log: DataFrame) -> DataFrame:
    """Upserts that put an item into another folder than its upsert before: ``seq, id, old_parent, parent``."""
    before = Window.partitionBy("id").orderBy("seq")
    ups = log.filter("op = 'upsert'").withColumn("old_parent", F.lag("parent").over(before))
    return ups.filter("old_parent <> parent").select("seq", "id", "old_parent", "parent")


def content_changes(log: DataFrame) -> DataFrame:
    """Upserts whose content differs from that of the item's upsert before."""
    before = Window.partitionBy("id").orderBy("seq")
    ups = log.filter("op = 'upsert'").withColumn("old_content", F.lag("content").over(before))
    return ups.filter("old_content <> content").select("seq", "id", "old_content", "content")


def changes_marked(log: DataFrame, shown: DataFrame, since: int, upto: int) -> DataFrame:
    """Every item whose latest change up to ``upto`` is after ``since``, and whether a working set of ids must learn it.

    An item is ``reported`` if itself, its folder or the folder it came from is in the working set.
    """
    prior = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto_log = log.filter(F.col("seq") <= upto).withColumn("old_parent", F.last("parent", ignorenulls=True).over(prior))
    last = upto_log.groupBy("id").agg(F.max_by(F.struct("seq", "op", "parent", "old_parent", "content"), order()).alias("x")).select("id", "x.*")
    last = last.filter(F.col("seq") > since)
    keys = last.select("id", F.explode(F.array("id", "parent", "old_parent")).alias("key")).join(shown.select(F.col("id").alias("key")), "key", "left_semi")
    marked = last.join(keys.select("id").distinct().withColumn("in", F.lit(True)), "id", "left")
    return marked.select("seq", "id", "op", "parent", "old_parent", "content", F.coalesce("in", F.lit(False)).alias("reported"))


def changes_since(log: DataFrame, shown: DataFrame, since: int, upto: int) -> DataFrame:
    """What a client at ``since`` must learn up to ``upto``, for a working set of ids: each item by its latest change only."""
    return changes_marked(log, shown, since, upto).filter("reported").drop("reported")


def page(log: DataFrame, shown: DataFrame, since: int, upto: int, limit: int) -> DataFrame:
    """The first ``limit`` reported changes in order: ``seq, id, op, more, anchor``.

    Only reported changes count towards the limit. If changes follow, reported or not, there is ``more`` and the
    next page resumes from the last one given; else the anchor moves over all unreported ones to ``upto``.
    With nothing to report there is one row without ``seq``, for the anchor. A page is as large as
    its limit, whatever the log.
    """
    marked = stored(changes_marked(log, shown, since, upto), "page")
    first = marked.filter("reported").orderBy("seq").limit(limit)
    cut = first.agg(F.count("*").alias("n"), F.max("seq").alias("cut"))
    latest = marked.agg(F.max("seq").alias("latest"))
    more = F.coalesce((F.col("n") >= limit) & (F.col("latest") > F.col("cut")), F.lit(False))
    end = cut.join(latest, how="cross").select(more.alias("more"), F.when(more, F.col("cut")).otherwise(F.lit(upto)).alias("anchor"))  # one row each
    return end.join(first.select("seq", "id", "op"), how="left").select("seq", "id", "op", "more", "anchor")


def missing(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known rows that a snapshot did not show."""
    return known.join(seen.select("id"), "id", "left_anti")


def listing_drops(known: DataFrame, listed: DataFrame, since: int) -> DataFrame:
    """Children that a listing lacks, unless they changed after it was made."""
    return missing(known, listed).filter(F.col("seq") <= since)


def resume_choice(log: DataFrame, clients: DataFrame, gc_seq: int, slack: int = 10_000) -> DataFrame:
    """``client, anchor, tombs, mode``: resume if the anchor is legal and what to send is not too much, else snapshot.

    Tombstones are numbered once; a client's are all but those numbered up to its anchor.
    """
    dead = numbered(tombstones(log).select("seq"), "seq")
    one = live(log).agg(F.count("*").alias("alive")).join(log.agg(F.max("seq").alias("now")), how="cross").join(dead.agg(F.count("*").alias("dead")), how="cross")  # one row each
    sent = as_of(clients.select("client", "anchor"), dead, "anchor", "seq", "at").join(one, how="cross").withColumn("tombs", F.col("dead") - F.coalesce("at", F.lit(0)))
    legal = F.col("anchor").between(gc_seq, F.col("now"))
    return sent.select("client", "anchor", "tombs", F.when(legal & (F.col("tombs") <= F.col("alive") + slack), "resume").otherwise("snapshot").alias("mode"))


def tombstone_gc(tombs: DataFrame, now_ns: int, max_age_ns: int, max_count: int) -> DataFrame:
    """Tombstones to drop: too old, or beyond the newest ``max_count``; the largest of them is the horizon."""
    newest = tombs.select("seq").orderBy(F.desc("seq")).limit(max_count).agg(F.min("seq").alias("floor"), F.count("*").alias("n"))
    joined = tombs.join(newest, how="cross")  # one row
    old = (F.lit(now_ns) - F.col("wall_ns")) > max_age_ns
    beyond = (F.col("n") == max_count) & (F.col("seq") < F.col("floor"))
    return joined.filter(old | beyond).select("seq", "id")


def as_of(keys: DataFrame, samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds the ``value`` of the latest sample at or before each key; null before the first, and for a null key.

    Of samples at one place the greatest value counts; samples without place or value don't. Keys and
    samples are merged in one order and dealt into ranges once, which are stored, as ranges made anew would
    have other borders. Within a range the last sample is carried forward, and each range starts from the last
    sample of those before it. Rows of one key may lie in many ranges.
    """
    kind = dict(samples.dtypes)[value]
    asked = keys.select("*", F.col(key).alias("_key"), F.lit(1).alias("_is"), F.lit(None).cast(kind).alias("_value"))
    known = samples.filter(F.col(at).isNotNull() & F.col(value).isNotNull())
    known = known.select(*[F.lit(None).cast(t).alias(c) for c, t in keys.dtypes], F.col(at).alias("_key"), F.lit(0).alias("_is"), F.col(value).alias("_value"))
    dealt = asked.unionByName(known).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("_key", "_is", "_value", "_salt")
    both = stored(dealt.withColumn("_part", F.spark_partition_id()).drop("_salt"), "as-of")
    ordered = Window.partitionBy("_part").orderBy("_key", "_is", "_value").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_own", F.last("_value", ignorenulls=True).over(ordered))
    ends = both.groupBy("_part").agg(F.max(F.when(F.col("_is") == 0, F.struct("_key", "_value"))).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", F.last("_end._value", ignorenulls=True).over(before).alias("_start"))  # a row for each range
    out = carried.filter("_is = 1").join(F.broadcast(starts), "_part").withColumn(value, F.when(F.col("_key").isNotNull(), F.coalesce("_own", "_start")))
    return out.select(*keys.columns, value)


def replay(journal: DataFrame) -> DataFrame:
    """A journal up to its first bad record, folded: ``journal`` has the log's columns and ``good``."""
    bad = journal.filter(~F.col("good")).agg(F.min("seq").alias("stop"))
    whole = journal.join(bad, how="cross").filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop")))  # one row
    return fold(whole)


def batch_masks(events: DataFrame) -> DataFrame:
    """One row per folder and name of a batch: masks ORed, the first position kept."""
    return events.groupBy("dir", "name").agg(F.bit_or("mask").alias("mask"), F.min("pos").alias("pos"), F.count("*").alias("n"))


def touched(log: DataFrame) -> DataFrame:
    """All ids and folders that a batch concerns, once each."""
    return log.select(F.col("id")).union(log.filter("parent IS NOT NULL").select("parent")).distinct()


def unpaired_moves(events: DataFrame) -> DataFrame:
    """First halves of renames whose second half has not come: ``events`` has ``pos, half, cookie``."""
    return events.filter("half = 'from'").join(events.filter("half = 'to'").select("cookie"), "cookie", "left_anti").select("pos", "cookie")


def expired(clients: DataFrame, horizon: int, now: int) -> DataFrame:
    """Whether a client's anchor can no longer be served: below the horizon, or from the future."""
    return clients.select("client", "anchor", ((F.col("anchor") < horizon) | (F.col("anchor") > now)).alias("expired"))


def numbered(rows: DataFrame, *by) -> DataFrame:
    """Adds ``at``, from 1 in the order ``by``. Ranges of the order are numbered in parallel; each adds what is before it."""
    parts = stored(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")
    inner = parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*by)))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(before.select("part", "before"), "part").withColumn("at", (F.col("k") + F.col("before")).cast("long")).drop("part", "k", "before")


def upserts_then_removals(log: DataFrame) -> DataFrame:
    """One batch in publishing order: upserts in their order, then removals, numbered from 1."""
    return numbered(log.select("seq", "id", "op", (F.col("op") == "remove").cast("int").alias("last")), "last", "seq").drop("last")


def _clients(log: DataFrame) -> DataFrame:
    return log.filter("seq % 400 = 0").select((F.col("seq") / 400).cast("long").alias("client"), F.col("seq").alias("anchor"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    half = F.when(F.col("content") % 3 == 0, "from").when(F.col("content") % 3 == 1, "to").otherwise("other")
    return log.select(
        (F.col("id") % 20).alias("dir"), F.coalesce("parent", F.lit(99)).alias("name"), F.expr("shiftleft(1L, cast(coalesce(content, 0) % 12 AS int))").alias("mask"),
        F.col("seq").alias("pos"), half.alias("half"), F.floor(F.col("seq") / 3).alias("cookie"),
    )


EVENTS = """events2 AS (SELECT id % 20 AS dir, coalesce(parent, 99) AS name, CAST(1 << CAST(coalesce(content, 0) % 12 AS INTEGER) AS BIGINT) AS mask, seq AS pos,
  CASE content % 3 WHEN 0 THEN 'from' WHEN 1 THEN 'to' ELSE 'other' END AS half, seq // 3 AS cookie FROM change_log)"""
LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op = 'remove' DESC) AS r FROM change_log) WHERE r = 1)"
DAY = 86_400_000_000_000


def _gc(s, d):
    tombs = tombstones(change_log(s, d))
    return tombstone_gc(tombs, 1_706_600_000_000_000_000, 2 * DAY, 20)


def _journal(s: SparkSession, d: str) -> DataFrame:
    """A journal whose last hundredth begins with a torn record."""
    log = change_log(s, d)
    torn = log.agg((F.max("seq") * 99 / 100).cast("long").alias("torn"))
    return replay(log.join(torn, how="cross").withColumn("good", F.col("seq") != F.col("torn")).drop("torn"))  # one row


QUERIES = {
    "changes_since": lambda s, d: changes_since(change_log(s, d), folders_shown(s), 700, 1000),
    "changes_since_late": lambda s, d: changes_since(change_log(s, d), folders_shown(s), 9000, 10_000),
    "changes_page": lambda s, d: page(change_log(s, d), folders_shown(s), 700, 9000, 40),
    "changes_last_page": lambda s, d: page(change_log(s, d), folders_shown(s), 8000, 9000, 100_000),
    "lww_fold": lambda s, d: fold(change_log(s, d)),
    "live_items": lambda s, d: live(change_log(s, d)),
    "tombstones": lambda s, d: tombstones(change_log(s, d)),
    "moves": lambda s, d: moves(change_log(s, d)),
    "content_changes": lambda s, d: content_changes(change_log(s, d)),
    "snapshot_missing": lambda s, d: missing(fold(change_log(s, d)).select("id", "seq"), live(change_log(s, d)).filter("parent < 12")),
    "listing_drops": lambda s, d: listing_drops(live(change_log(s, d)).select("id", "seq"), change_log(s, d).filter("seq % 97 = 0").select("id").distinct(), 9500),
    "resume_choice": lambda s, d: resume_choice(change_log(s, d), _clients(change_log(s, d)), 1000, 0),
    "tombstone_gc": _gc,
    "gc_horizon": lambda s, d: _gc(s, d).agg(F.max("seq").alias("horizon"), F.count("*").alias("dropped")),
    "time_of_seq": lambda s, d: as_of(change_log(s, d).select("seq", "id"), seq_times(s, d).withColumnRenamed("seq", "sample"), "seq", "sample", "wall_ns"),
    "server_seq_at": lambda s, d: as_of(_clients(change_log(s, d)), seq_times(s, d).select((F.col("seq") * 3).alias("local_seq"), F.col("seq").alias("server_seq")), "anchor", "local_seq", "server_seq"),
    "journal_replay": lambda s, d: _journal(s, d),
    "batch_masks": lambda s, d: batch_masks(_events(s, d)),
    "touched_ids": lambda s, d: touched(change_log(s, d)),
    "unpaired_moves": lambda s, d: unpaired_moves(_events(s, d)),
    "expired_anchors": lambda s, d: expired(_clients(change_log(s, d)), 2000, 8000),
    "publish_order": lambda s, d: upserts_then_removals(change_log(s, d)),
}

_SINCE = """, prior AS (SELECT *, last_value(parent IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_parent FROM change_log WHERE seq <= {upto}),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op = 'remove' DESC) AS r FROM prior) WHERE r = 1)
SELECT seq, id, op, parent, old_parent, content FROM newest WHERE seq > {since}
  AND (id IN (SELECT id FROM folders_shown) OR parent IN (SELECT id FROM folders_shown) OR old_parent IN (SELECT id FROM folders_shown))"""
_PAGE = _SINCE.replace("SELECT seq, id, op, parent, old_parent, content FROM newest", ", told AS (SELECT seq, id, op FROM newest") + """), first AS (SELECT * FROM told ORDER BY seq LIMIT {limit}),
ended AS (SELECT count(*) = {limit} AND max(seq) < (SELECT max(seq) FROM newest) AS more, max(seq) AS cut FROM first)
SELECT seq, id, op, more, CASE WHEN more THEN cut ELSE {upto} END AS anchor FROM ended LEFT JOIN first ON true"""
_TOMBS = """, tombs AS (SELECT id, seq, old_parent, wall_ns FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op = 'remove' DESC) AS r,
  last_value(parent IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS old_parent FROM change_log) WHERE r = 1 AND op = 'remove')"""
_DROPPED = f""", ranked AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS n FROM tombs),
dropped AS (SELECT seq, id FROM ranked WHERE 1706600000000000000 - wall_ns > {2 * DAY} OR n > 20)"""
_CLIENTS = ", clients AS (SELECT seq // 400 AS client, seq AS anchor FROM change_log WHERE seq % 400 = 0)"
_ORACLES = {
    "changes_since": "WITH change_log AS ({v}), folders_shown AS ({f})" + _SINCE.replace("{since}", "700").replace("{upto}", "1000"),
    "changes_since_late": "WITH change_log AS ({v}), folders_shown AS ({f})" + _SINCE.replace("{since}", "9000").replace("{upto}", "10000"),
    "changes_page": "WITH change_log AS ({v}), folders_shown AS ({f})" + _PAGE.replace("{since}", "700").replace("{upto}", "9000").replace("{limit}", "40"),
    "changes_last_page": "WITH change_log AS ({v}), folders_shown AS ({f})" + _PAGE.replace("{since}", "8000").replace("{upto}", "9000").replace("{limit}", "100000"),
    "lww_fold": f"WITH change_log AS ({{v}}), {LAST} SELECT id, seq, op, parent, content FROM last",
    "live_items": f"WITH change_log AS ({{v}}), {LAST} SELECT id, seq, parent, content FROM last WHERE op = 'upsert'",
    "tombstones": f"WITH change_log AS ({{v}}){_TOMBS} SELECT * FROM tombs",
    "moves": "WITH change_log AS ({v}) SELECT seq, id, old_parent, parent FROM (SELECT *, lag(parent) OVER (PARTITION BY id ORDER BY seq) AS old_parent FROM change_log WHERE op = 'upsert') WHERE old_parent <> parent",
    "content_changes": "WITH change_log AS ({v}) SELECT seq, id, old_content, content FROM (SELECT *, lag(content) OVER (PARTITION BY id ORDER BY seq) AS old_content FROM change_log WHERE op = 'upsert') WHERE old_content <> content",
    "snapshot_missing": f"WITH change_log AS ({{v}}), {LAST} SELECT id, seq FROM last WHERE id NOT IN (SELECT id FROM last WHERE op = 'upsert' AND parent < 12)",
    "listing_drops": f"WITH change_log AS ({{v}}), {LAST} SELECT id, seq FROM last WHERE op = 'upsert' AND seq <= 9500 AND id NOT IN (SELECT id FROM change_log WHERE seq % 97 = 0)",
    "resume_choice": f"""WITH change_log AS ({{v}}), {LAST}{_TOMBS}{_CLIENTS} SELECT client, anchor, tombs, CASE WHEN anchor BETWEEN 1000 AND (SELECT max(seq) FROM change_log)
  AND tombs <= (SELECT count(*) FROM last WHERE op = 'upsert') THEN 'resume' ELSE 'snapshot' END AS mode
FROM (SELECT client, anchor, (SELECT count(*) FROM tombs WHERE seq > anchor) AS tombs FROM clients)""",
    "tombstone_gc": f"WITH change_log AS ({{v}}){_TOMBS}{_DROPPED} SELECT * FROM dropped",
    "gc_horizon": f"WITH change_log AS ({{v}}){_TOMBS}{_DROPPED} SELECT max(seq) AS horizon, count(*) AS dropped FROM dropped",
    "time_of_seq": "WITH change_log AS ({v}), times AS (SELECT seq AS sample, wall_ns FROM change_log WHERE seq % 50 = 0) SELECT c.seq, c.id, t.wall_ns FROM change_log c ASOF LEFT JOIN times t ON c.seq >= t.sample",
    "server_seq_at": f"WITH change_log AS ({{v}}){_CLIENTS}, t AS (SELECT seq * 3 AS local_seq, seq AS server_seq FROM change_log WHERE seq % 50 = 0) SELECT client, anchor, server_seq FROM clients ASOF LEFT JOIN t ON anchor >= local_seq",
    "journal_replay": "WITH change_log AS ({v}), good AS (SELECT * FROM change_log WHERE seq < (SELECT CAST(floor(max(seq) * 99 / 100.0) AS BIGINT) FROM change_log)) SELECT id, seq, op, parent, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op = 'remove' DESC) AS r FROM good) WHERE r = 1",
    "batch_masks": f"WITH change_log AS ({{v}}), {EVENTS} SELECT dir, name, bit_or(mask) AS mask, min(pos) AS pos, count(*) AS n FROM events2 GROUP BY 1, 2",
    "touched_ids": "WITH change_log AS ({v}) SELECT id FROM change_log UNION SELECT parent FROM change_log WHERE parent IS NOT NULL",
    "unpaired_moves": f"WITH change_log AS ({{v}}), {EVENTS} SELECT pos, cookie FROM events2 WHERE half = 'from' AND cookie NOT IN (SELECT cookie FROM events2 WHERE half = 'to')",
    "expired_anchors": f"WITH change_log AS ({{v}}){_CLIENTS} SELECT client, anchor, anchor < 2000 OR anchor > 8000 AS expired FROM clients",
    "publish_order": "WITH change_log AS ({v}) SELECT seq, id, op, row_number() OVER (ORDER BY op = 'remove', seq) AS at FROM change_log",
}
ORACLE_SQL = {k: q.replace("{v}", VIEWS["change_log"]).replace("{f}", VIEWS["folders_shown"]) for k, q in _ORACLES.items()}
