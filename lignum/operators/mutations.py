"""Proposed changes judged against current state: writes, renames, removals, and what a scan saw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.functions.names import is_bounce, is_valid, numbered
from lignum.functions.rules import with_execute
from lignum.operators.tree import above, subtree, with_ancestors
from lignum.session import stored
from lignum.sources.relations import LEVEL, items, read, with_views

TRASH = -1


def write_outcomes(proposals: DataFrame, current: DataFrame, done: DataFrame) -> DataFrame:
    """``op, outcome`` of writes to existing items; the first rule that holds decides.

    ``proposals`` has ``op, id, base, hash`` (a null base is unknown), ``current`` ``id, kind, content, hash``,
    ``done`` the ops already answered. A repeated op is answered as before; an item that is gone or isn't a
    file is refused; a base that isn't the content now is a conflict, unless the bytes are the same.
    """
    now = current.select("id", F.col("kind"), F.col("content"), F.col("hash").alias("now_hash"))
    both = proposals.join(now, "id", "left").join(done.select("op", F.lit(True).alias("stored")), "op", "left")
    stale = F.col("base").isNotNull() & (F.col("base") != F.col("content"))
    outcome = (
        F.when(F.col("stored"), "stored")
        .when(F.col("kind").isNull(), "gone")
        .when(F.col("kind") == "Dir", "is a folder")
        .when(F.col("kind") != "File", "unsupported")
        .when(stale & F.col("hash").eqNullSafe(F.col("now_hash")), "identical")
        .when(stale, "conflict copy")
        .otherwise("replaced")
    )
    return both.select("op", outcome.alias("outcome"))


def create_outcomes(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """``op, outcome`` of creations ``op, parent, name, kind, hash, may_exist``: created, the same item, or the name is taken."""
    now = current.select("parent", "name", F.col("id").alias("there"), F.col("kind").alias("its_kind"), F.col("hash").alias("its_hash"))
    same = (F.col("kind") == F.col("its_kind")) & (F.col("hash").eqNullSafe(F.col("its_hash")) | (F.col("kind") != "File"))
    outcome = F.when(F.col("there").isNull(), "created").when(F.col("may_exist") & same, "existing").when(F.col("may_exist") & (F.col("kind") == F.col("its_kind")), "conflict copy").otherwise("taken")
    return proposals.join(now, ["parent", "name"], "left").select("op", outcome.alias("outcome"))


def rename_outcomes(proposals: DataFrame, tree: DataFrame) -> DataFrame:
    """``op, outcome`` of moves ``op, id, base_parent, base_name, parent, name``.

    Not applied if the item is elsewhere by now; applied if it is there already; not applied if the folder
    is gone; invalid into itself or below; taken names are never overwritten.
    """
    live = tree.select("id", F.col("parent").alias("now_parent"), F.col("name").alias("now_name"))
    target = tree.filter("kind = 'Dir'").select(F.col("id").alias("parent"), F.lit(True).alias("folder"))
    inside = above(tree, proposals.select(F.col("parent").alias("id"))).select(F.col("id").alias("parent"), F.col("ancestor").alias("id"), F.lit(True).alias("below"))
    taken = tree.select("parent", "name", F.lit(True).alias("taken"))
    both = proposals.join(live, "id", "left").join(target, "parent", "left").join(inside, ["parent", "id"], "left").join(taken, ["parent", "name"], "left")
    there = (F.col("now_parent") == F.col("parent")) & (F.col("now_name") == F.col("name"))
    as_based = (F.col("now_parent") == F.col("base_parent")) & (F.col("now_name") == F.col("base_name"))
    outcome = F.when(there, "there already").when(~F.coalesce(as_based, F.lit(False)), "not applied").when(F.col("folder").isNull(), "not applied").when(F.col("below"), "invalid").when(F.col("taken"), "taken").otherwise("applied")
    return both.select("op", outcome.alias("outcome"))


def kept_on_remove(tree: DataFrame, root: int, seen_seq: int) -> DataFrame:
    """``id, kept`` of a removed subtree: what changed after the client saw it stays, with all folders above it.

    A folder below ``root`` that arrived in its place after that (its ``meta`` is newer) is new to the client as a
    whole, whatever lies in it: it stays with its subtree. Items that are moved in keep their own ``seq``.
    """
    inside = stored(subtree(tree, tree.filter(F.col("id") == root)).select("id").join(tree.select("id", "seq", "kind", "meta"), "id"), "removed")
    arrived = inside.filter((F.col("kind") == "Dir") & (F.col("meta") > seen_seq) & (F.col("id") != root)).select("id")
    newer = inside.filter(F.col("seq") > seen_seq).select("id").union(subtree(tree, arrived).select("id")).distinct()
    stays = with_ancestors(tree, newer).withColumn("kept", F.lit(True))
    return inside.select("id").join(stays, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def scanned(seen: DataFrame, known: DataFrame) -> DataFrame:
    """What each row of a scan is: the same, moved here, replaced in place (the id stays), or new.

    Both have ``parent, name, kind, dev, ino, born`` and ``known`` has ``id``. Identity is found first, then the place. A device and inode used
    again show by their birth times, where both know it; of several known names of an inode the one here counts, then the least id.
    """
    by_ino = known.select("dev", "ino", "kind", F.col("born").alias("was_born"), F.struct(F.lit(1).alias("far"), F.col("id"), F.col("parent").alias("p"), F.col("name").alias("n")).alias("one"))
    by_place = known.select("parent", "name", F.col("id").alias("place_id"), F.col("kind").alias("k"))
    same = F.coalesce(F.col("born") == F.col("was_born"), F.lit(True))
    here = (F.col("one.p") == F.col("parent")) & (F.col("one.n") == F.col("name"))
    rows = seen.join(by_ino, ["dev", "ino", "kind"], "left").withColumn("one", F.when(F.col("one").isNotNull() & same, F.struct((~here).cast("int").alias("far"), "one.id")))
    rows = rows.groupBy("parent", "name", "kind").agg(F.min("one").alias("one"))
    both = rows.join(by_place, ["parent", "name"], "left")
    what = F.when(F.col("one.far") == 0, "same").when(F.col("one").isNotNull(), "moved").when(F.col("k") == F.col("kind"), "replaced").otherwise("new")
    return both.select("parent", "name", F.coalesce("one.id", F.when(F.col("k") == F.col("kind"), F.col("place_id"))).alias("id"), what.alias("what"))


def stat_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which parts of an item changed: 1 content, 2 attributes, 4 anything else; unchanged ones are left out."""
    new = after.select("id", *[F.col(c).alias(f"new_{c}") for c in ("size", "mtime_ns", "mode", "access")])
    both = before.join(new, "id")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    bits = F.when(differs("size") | differs("mtime_ns"), 1).otherwise(0) + F.when(differs("mode"), 2).otherwise(0) + F.when(differs("access"), 4).otherwise(0)
    return both.select("id", bits.alias("changed")).filter("changed <> 0")


def deletions(proposals: DataFrame, tree: DataFrame) -> DataFrame:
    """``op, outcome`` of deletions ``op, id, content_base, meta_base, seen_seq, recursive``; the first rule that holds decides.

    Done if the item is unknown. Rejected for the root, for a base that isn't the version now, for a base that isn't known where the item changed after
    what the client has seen, and for a folder that isn't empty if only it is meant.
    """
    full = tree.filter("parent IS NOT NULL").select(F.col("parent").alias("id"), F.lit(True).alias("full")).distinct()
    both = proposals.join(tree.select("id", "parent", "content", "meta", "seq", F.lit(True).alias("known")), "id", "left").join(full, "id", "left")
    stale = (F.col("content_base").isNotNull() & (F.col("content_base") != F.col("content"))) | (F.col("meta_base").isNotNull() & (F.col("meta_base") != F.col("meta")))
    unseen = (F.col("content_base").isNull() | F.col("meta_base").isNull()) & (F.col("seq") > F.col("seen_seq"))
    rejected = F.col("parent").isNull() | stale | F.coalesce(unseen, F.lit(False)) | (F.col("full") & ~F.col("recursive"))
    return both.select("op", F.when(F.col("known").isNull(), "done").when(F.coalesce(rejected, F.lit(False)), "rejected").otherwise("deleted").alias("outcome"))


def modifications(proposals: DataFrame, tree: DataFrame, mapped: DataFrame) -> DataFrame:
    """``op, place, content, fetch`` of a client's changes to an item: what becomes of its new place, what is sent, and whether newer content must be fetched.

    ``proposals`` has ``op, id, parent, name, meta_base, content_base, writes, holds``; ``mapped`` (``id``) are items shown under a number. Into the trash
    is a ``delete`` and sends nothing. A new name of a mapped item that only numbers its own is ``shown`` and goes no further. A
    move on a ``meta`` that isn't the one now (or unknown), or to a name that isn't valid, is ``dropped``. Content that is written goes out
    with its base, or ``as 0``, which matches no version, where the base is unknown. An item whose content is newer than what
    the client ``holds`` is fetched, unless it is written. Unknown items are ``gone``.
    """
    now = tree.select("id", F.col("parent").alias("now_parent"), F.col("name").alias("now_name"), F.col("meta"), F.col("content").alias("now_content"))
    both = proposals.join(now, "id", "left").join(mapped.select("id", F.lit(True).alias("mapped")), "id", "left")
    moves = (F.col("parent") != F.col("now_parent")) | (F.col("name") != F.col("now_name"))
    bounce = F.coalesce(F.col("mapped"), F.lit(False)) & (F.col("parent") == F.col("now_parent")) & is_bounce(F.col("now_name"), F.col("name"))
    place = (
        F.when(F.col("now_name").isNull(), "gone").when(F.col("parent") == TRASH, "delete").when(~moves, "stays").when(bounce, "shown")
        .when(~F.col("meta_base").eqNullSafe(F.col("meta")) | ~is_valid(F.col("name")), "dropped").otherwise("moved")
    )
    there = ~place.isin("gone", "delete")
    content = F.when(there & F.col("writes"), F.when(F.col("content_base").isNull(), "as 0").otherwise("sent")).otherwise("none")
    return both.select("op", place.alias("place"), content.alias("content"), F.coalesce(there & ~F.col("writes") & (F.col("now_content") > F.col("holds")), F.lit(False)).alias("fetch"))


def attributes_set(proposals: DataFrame, tree: DataFrame) -> DataFrame:
    """``op, mode, mtime_ns, outcome`` of ``op, id, execute, mtime_ns`` (null: as it is): the right to execute is a file's only, and a link keeps its mode."""
    both = proposals.withColumnRenamed("mtime_ns", "new_mtime").join(tree.select("id", "kind", "mode", "mtime_ns"), "id", "left")
    mode = F.when(F.col("execute").isNull() | (F.col("kind") != "File"), F.col("mode")).otherwise(with_execute(F.col("mode"), F.col("execute")))
    changed = ~mode.eqNullSafe(F.col("mode")) | (F.col("new_mtime").isNotNull() & ~F.col("new_mtime").eqNullSafe(F.col("mtime_ns")))
    return both.select("op", mode.cast("int").alias("mode"), F.coalesce("new_mtime", "mtime_ns").alias("mtime_ns"), F.when(F.col("kind").isNull(), "gone").when(changed, "set").otherwise("as it was").alias("outcome"))


def _writes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    doc = read(s, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    current = doc.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "Dir").when(F.col("doc_id") % 15 == 1, "Symlink").otherwise("File").alias("kind"), (F.col("doc_id") * 2).alias("content"), F.sha2("text", 256).alias("hash"))
    base = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, F.col("doc_id") * 2).otherwise(F.col("doc_id"))
    hashed = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256)
    asked = doc.select(F.col("doc_id").alias("op"), F.when(F.col("doc_id") % 21 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("id"), base.alias("base"), hashed.alias("hash"))
    return asked, current, s.range(0, 1000, 33).select(F.col("id").alias("op"))


def _hashed(tree: DataFrame) -> DataFrame:
    return tree.withColumn("hash", F.sha2(F.col("name"), 256))


def _arrivals(s: SparkSession, d: str) -> DataFrame:
    """The tree, where every ninth folder has been moved in of late."""
    return items(s, d).withColumn("meta", F.when((F.col("kind") == "Dir") & (F.col("id") % 9 == 4), F.lit(9000)).otherwise(F.lit(1)))


def _creates(s, d):
    t = _hashed(items(s, d).filter("parent IS NOT NULL"))
    name = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name"))
    digest = F.when(F.col("id") % 5 == 0, F.sha2(F.concat("name", F.lit("!")), 256)).otherwise(F.col("hash"))
    return t.select(F.col("id").alias("op"), "parent", name.alias("name"), F.when(F.col("id") % 7 == 0, "Symlink").otherwise(F.col("kind")).alias("kind"), digest.alias("hash"), (F.col("id") % 2 == 0).alias("may_exist"))


def _renames(s, d):
    t = items(s, d).filter("parent IS NOT NULL AND kind = 'Dir'")
    k = F.col("id") % 6
    parent = F.when(k == 0, F.col("parent")).when(k == 1, F.col("id")).when(k == 2, F.lit(-5)).otherwise(F.lit(LEVEL + 1)).cast("long")
    name = F.when(k == 3, "FRANCE").otherwise(F.col("name"))
    base = F.when(k == 4, F.concat("name", F.lit("?"))).otherwise(F.col("name"))
    return t.select(F.col("id").alias("op"), "id", F.col("parent").alias("base_parent"), base.alias("base_name"), parent.alias("parent"), name.alias("name"))


def _scan(s, d):
    t = items(s, d).filter("parent IS NOT NULL")
    known = t.select("id", "parent", "name", "kind", F.lit(1).alias("dev"), F.col("id").alias("ino"), F.when(F.col("id") % 3 != 0, F.col("mtime_ns")).alias("born"))
    k = F.col("id") % 8
    seen = known.select(
        "parent", F.when(k == 1, F.concat("name", F.lit(" new"))).when(k == 2, F.concat("name", F.lit(" moved"))).otherwise(F.col("name")).alias("name"),
        F.when(k == 5, "Symlink").otherwise(F.col("kind")).alias("kind"), "dev", F.when(k.isin(1, 3, 5), -F.col("ino")).otherwise(F.col("ino")).alias("ino"),
        F.when(k == 6, F.col("born") + 1).when(k == 7, F.lit(None)).otherwise(F.col("born")).alias("born"),
    )
    return scanned(seen, known)


def _after(s, d):
    m = lambda c, k, more: F.when(F.col("id") % k == 0, F.col(c) + more).otherwise(F.col(c))
    return items(s, d).select("id", m("size", 5, 1).alias("size"), m("mtime_ns", 7, 1).alias("mtime_ns"), m("mode", 11, 1).alias("mode"), m("access", 13, 8).alias("access"))


def _deletes(s, d):
    base = F.when(F.col("id") % 3 == 0, F.col("content")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("content") + 1)
    return items(s, d).select(F.col("id").alias("op"), F.when(F.col("id") % 10 == 9, -F.col("id")).otherwise(F.col("id")).alias("id"), base.alias("content_base"), F.when(F.col("id") % 7 != 0, F.col("meta") + F.when(F.col("id") % 7 == 1, 1).otherwise(0)).alias("meta_base"), (F.col("seq") - F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("seen_seq"), (F.col("id") % 2 == 0).alias("recursive"))


def _modified(s, d):
    t = items(s, d).filter("parent IS NOT NULL")
    k = F.col("id") % 9
    parent = F.when(k == 0, F.lit(TRASH)).when(k == 1, F.col("parent") + 1).otherwise(F.col("parent"))
    name = F.when(k.isin(2, 3), numbered("name", F.lit(2))).when(k == 4, F.lit("a/b")).when(k == 5, F.concat(F.lit("new "), "name")).otherwise(F.col("name"))
    asked = t.select(
        F.col("id").alias("op"), F.when(F.col("id") % 50 == 7, -F.col("id")).otherwise(F.col("id")).alias("id"), parent.cast("long").alias("parent"), name.alias("name"),
        F.when(F.col("id") % 4 == 0, F.col("meta") + 1).when(F.col("id") % 4 != 1, F.col("meta")).alias("meta_base"), F.when(F.col("id") % 5 == 0, F.col("content")).alias("content_base"), (F.col("id") % 2 == 0).alias("writes"), (F.col("content") - F.col("id") % 3).alias("holds"),
    )
    return modifications(asked, t, t.filter("id % 9 = 2").select("id"))


def _set(s, d):
    t = items(s, d)
    k = F.col("id") % 4
    kinds = t.withColumn("kind", F.when(F.col("id") % 5 == 3, "Symlink").otherwise(F.col("kind")))
    asked = t.select(F.col("id").alias("op"), F.when(F.col("id") % 50 == 7, -F.col("id")).otherwise(F.col("id")).alias("id"), F.when(k == 1, F.lit(True)).when(k == 2, F.lit(False)).alias("execute"), F.when(F.col("id") % 3 == 0, F.col("mtime_ns") + 1).when(F.col("id") % 3 == 1, F.col("mtime_ns")).alias("mtime_ns"))
    return attributes_set(asked, kinds)


QUERIES = {
    "write_outcomes": lambda s, d: write_outcomes(*_writes(s, d)),
    "create_outcomes": lambda s, d: create_outcomes(_creates(s, d), _hashed(items(s, d))),
    "rename_outcomes": lambda s, d: rename_outcomes(_renames(s, d), items(s, d)),
    "kept_on_remove": lambda s, d: kept_on_remove(_arrivals(s, d), LEVEL + 2, 5000),
    "scanned": _scan,
    "stat_changes": lambda s, d: stat_changes(items(s, d), _after(s, d)),
    "deletions": lambda s, d: deletions(_deletes(s, d), items(s, d)),
    "modifications": _modified,
    "attributes_set": _set,
}
ORACLE_SQL = {
    "write_outcomes": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 21 = 0 AS gone FROM documents)
SELECT doc_id AS op, CASE WHEN doc_id % 33 = 0 AND doc_id < 1000 THEN 'stored' WHEN gone THEN 'gone' WHEN doc_id % 10 = 0 THEN 'is a folder' WHEN doc_id % 15 = 1 THEN 'unsupported'
  WHEN doc_id % 4 >= 2 AND doc_id <> doc_id * 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'identical' ELSE 'conflict copy' END ELSE 'replaced' END AS outcome FROM d""",
    "create_outcomes": with_views(
        """SELECT id AS op, CASE WHEN id % 3 = 0 THEN 'created' WHEN id % 2 = 0 AND id % 7 <> 0 AND (kind <> 'File' OR id % 5 <> 0) THEN 'existing' WHEN id % 2 = 0 AND id % 7 <> 0 THEN 'conflict copy' ELSE 'taken' END AS outcome FROM items WHERE parent IS NOT NULL""", "items"
    ),
    "rename_outcomes": with_views(
        f"""SELECT id AS op, CASE WHEN id % 6 = 0 THEN 'there already' WHEN parent = {LEVEL + 1} AND id % 6 > 3 THEN 'there already' WHEN parent = {LEVEL + 1} AND name = 'FRANCE' THEN 'there already' WHEN id % 6 = 4 THEN 'not applied' WHEN id % 6 = 2 THEN 'not applied' WHEN id % 6 = 1 THEN 'invalid'
  WHEN id = {LEVEL + 1} THEN 'invalid' WHEN EXISTS (SELECT 1 FROM items t WHERE t.parent = {LEVEL + 1} AND t.name = CASE WHEN i.id % 6 = 3 THEN 'FRANCE' ELSE i.name END) THEN 'taken' ELSE 'applied' END AS outcome
FROM items i WHERE parent IS NOT NULL AND kind = 'Dir'""", "items"
    ),
    "kept_on_remove": with_views(
        f""", inside AS MATERIALIZED (SELECT id FROM closure WHERE ancestor = {LEVEL + 2}),
stays AS MATERIALIZED (SELECT DISTINCT n.ancestor AS id FROM closure n JOIN items i ON i.id = n.id JOIN inside ON inside.id = n.id WHERE i.seq > 5000
  OR EXISTS (SELECT 1 FROM closure u JOIN items x ON x.id = u.ancestor JOIN inside y ON y.id = x.id WHERE u.id = n.id AND x.kind = 'Dir' AND x.id % 9 = 4 AND x.id <> {LEVEL + 2}))
SELECT inside.id, stays.id IS NOT NULL AS kept FROM inside LEFT JOIN stays ON stays.id = inside.id""", "items", "closure"
    ),
    "scanned": with_views(
        """SELECT parent, name || CASE id % 8 WHEN 1 THEN ' new' WHEN 2 THEN ' moved' ELSE '' END AS name, CASE WHEN id % 8 IN (1, 5) THEN NULL ELSE id END AS id,
  CASE id % 8 WHEN 1 THEN 'new' WHEN 2 THEN 'moved' WHEN 3 THEN 'replaced' WHEN 5 THEN 'new' WHEN 6 THEN CASE WHEN id % 3 <> 0 THEN 'replaced' ELSE 'same' END ELSE 'same' END AS what FROM items WHERE parent IS NOT NULL""", "items"
    ),
    "stat_changes": with_views(
        """SELECT * FROM (SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 2 ELSE 0 END + CASE WHEN id % 13 = 0 THEN 4 ELSE 0 END AS changed FROM items) WHERE changed <> 0""", "items"
    ),
    "deletions": with_views(
        """SELECT id AS op, CASE WHEN id % 10 = 9 THEN 'done' WHEN parent IS NULL OR id % 3 = 2 OR id % 7 = 1 OR ((id % 3 = 1 OR id % 7 = 0) AND id % 4 = 0) OR (id % 2 = 1 AND EXISTS (SELECT 1 FROM items c WHERE c.parent = i.id)) THEN 'rejected' ELSE 'deleted' END AS outcome FROM items i""", "items"
    ),
    "modifications": with_views(
        """SELECT id AS op, place, CASE WHEN place IN ('gone', 'delete') OR id % 2 = 1 THEN 'none' WHEN id % 5 = 0 THEN 'sent' ELSE 'as 0' END AS content, place NOT IN ('gone', 'delete') AND id % 2 = 1 AND id % 3 > 0 AS fetch FROM (
  SELECT id, CASE WHEN id % 50 = 7 THEN 'gone' WHEN k = 0 THEN 'delete' WHEN k > 5 THEN 'stays' WHEN k = 2 THEN 'shown' WHEN id % 4 < 2 OR k = 4 THEN 'dropped' ELSE 'moved' END AS place FROM (SELECT *, id % 9 AS k FROM items WHERE parent IS NOT NULL))""", "items"
    ),
    "attributes_set": with_views(
        """SELECT op, CAST(mode AS INTEGER) AS mode, mtime_ns, CASE WHEN gone THEN 'gone' WHEN mode <> was OR op % 3 = 0 THEN 'set' ELSE 'as it was' END AS outcome FROM (
  SELECT id AS op, id % 50 = 7 AS gone, mode AS was, CASE WHEN id % 50 = 7 THEN NULL WHEN k <> 'File' OR id % 4 IN (0, 3) THEN mode WHEN id % 4 = 1 THEN mode | ((mode & 292) >> 2) ELSE mode & 4022 END AS mode,
    CASE id % 3 WHEN 0 THEN mtime_ns + 1 WHEN 1 THEN mtime_ns ELSE CASE WHEN id % 50 <> 7 THEN mtime_ns END END AS mtime_ns FROM (SELECT *, CASE WHEN id % 5 = 3 THEN 'Symlink' ELSE kind END AS k FROM items))""", "items"
    ),
}
ORACLE_SQL["kept_on_remove"] = ORACLE_SQL["kept_on_remove"].replace(")\n, inside", "),\ninside")
