"""State changes of a tree, as logs: each takes a tree and gives changes; ``applied`` gives the next tree from both.

Changes have ``seq``, ``id``, ``op`` and the item's columns after an ``upsert``. A ``remove`` leaves a tombstone; a ``forget`` doesn't: the item
may come back under its id. Sequence numbers go on after ``last``, in order of the asking rows' ids, so changes of
several steps can be put in one log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.operators.chains import settled
from lignum.operators.log import numbered
from lignum.operators.tree import subtree, would_cycle
from lignum.session import stored
from lignum.sources.relations import LEVEL, ROOT, items, with_views

COLUMNS = ("id", "parent", "name", "kind", "size", "mtime_ns", "mode", "access", "content", "meta", "seq")


def _gone(ids: DataFrame, op: str) -> DataFrame:
    return ids.select("seq", "id", F.lit(op).alias("op"))


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "id", F.lit("upsert").alias("op"), *[c for c in COLUMNS if c not in ("seq", "id")])


#: Changes that one task folds, about; whole rows are sorted there.
PART_ROWS = 250_000


def applied(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree after a log of changes: each item as its last change leaves it; of changes at one number, a removal counts."""
    changes = stored(changes, "changes")
    last = changes.repartition(1 + changes.count() // PART_ROWS, "id").groupBy("id").agg(F.max_by(F.struct("op", *[c for c in COLUMNS if c != "id"]), F.struct("seq", F.col("op") != "upsert")).alias("x")).select("id", "x.*")
    rest = tree.select(*COLUMNS).join(last.select("id"), "id", "left_anti")
    return rest.unionByName(last.filter("op = 'upsert'").select(*COLUMNS))


def moved(tree: DataFrame, moves: DataFrame, last: int) -> DataFrame:
    """Moves ``id, parent, name`` that can be made together (see ``settled``), in the order they can be made; each is a new ``meta`` version.

    Moves into an item's own subtree, and of the root, are left out.
    """
    asked = stored(moves.join(would_cycle(tree, moves.select("id", "parent")).filter("NOT cycle").select("id"), "id", "left_semi").filter(F.col("id") != ROOT), "asked")
    made = settled(asked, tree).filter("outcome IN ('moved', 'swapped')").select("id", "round")
    made = numbered(made, "round", "id").select("id", (F.col("at") + last).alias("seq"))
    new = asked.select("id", F.col("parent").alias("to"), F.col("name").alias("as"))
    rows = tree.drop("seq").join(made, "id").join(new, "id").withColumns({"parent": F.col("to"), "name": F.col("as"), "meta": F.col("seq")})
    return _kept(rows)


def transplanted(tree: DataFrame, pairs: DataFrame, last: int) -> DataFrame:
    """``pairs`` (``id, source``): the item takes over all that its source is but place and id, children included; the source goes.

    An item or source is in one pair only. ``content`` is a new version, ``meta`` is one if the mode differs.
    """
    known = pairs.join(tree.select("id"), "id", "left_semi").join(tree.select(F.col("id").alias("source")), "source", "left_semi").filter("id <> source")
    known = stored(numbered(known.select("id", "source"), "id").select("id", "source", (F.col("at") + last).alias("seq")), "pairs")
    taken = ("size", "mtime_ns", "access", "mode")
    of = tree.select(F.col("id").alias("source"), *[F.col(c).alias(f"its_{c}") for c in taken])
    rows = tree.drop("seq").join(known, "id").join(of, "source")
    rows = rows.withColumns({"content": F.col("seq"), "meta": F.when(F.col("mode") == F.col("its_mode"), F.col("meta")).otherwise(F.col("seq"))}).withColumns({c: F.col(f"its_{c}") for c in taken})
    parents = known.select(F.col("source").alias("parent"), F.col("id").alias("to"), F.col("seq").alias("at"))
    kids = tree.join(known.select(F.col("source").alias("id")), "id", "left_anti").join(known.select("id"), "id", "left_anti").join(parents, "parent").withColumns({"parent": F.col("to"), "seq": F.col("at")})
    return _kept(rows).unionByName(_kept(kids)).unionByName(_gone(known.select("seq", F.col("source").alias("id")), "remove"), allowMissingColumns=True)


def collapsed(tree: DataFrame, folders: DataFrame, last: int) -> tuple[DataFrame, DataFrame]:
    """All below ``folders`` (``id``) is forgotten; its direct children are kept aside, by ``folder``, and can be brought back. The root stays open."""
    folders = stored(folders.filter(F.col("id") != ROOT).join(tree.filter("kind = 'Dir'").select("id"), "id", "left_semi").distinct(), "folders")
    below = subtree(tree, folders).filter("distance > 0").select("id").distinct()
    seqs = stored(numbered(folders, "id").select("id", (F.col("at") + last).alias("seq")), "collapsed")
    most = seqs.agg(F.max("seq").alias("seq"))  # one row
    outer = seqs.join(below, "id", "left_anti")
    rows = _kept(tree.drop("seq").join(outer, "id"))
    cold = tree.join(folders.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("parent").alias("folder"), *COLUMNS)
    return rows.unionByName(_gone(below.join(most, how="cross"), "forget"), allowMissingColumns=True), cold


def expanded(tree: DataFrame, cold: DataFrame, folders: DataFrame, last: int) -> DataFrame:
    """Brings back the children of ``folders`` (``id``) kept aside, under their ids and versions, unless their name has been taken meanwhile."""
    back = cold.join(folders.select(F.col("id").alias("folder")).distinct(), "folder", "left_semi").join(tree.select(F.col("id").alias("folder")), "folder", "left_semi")
    back = back.join(tree.select("parent", "name"), ["parent", "name"], "left_anti").select(*COLUMNS)
    return _kept(numbered(back.drop("seq"), "id").withColumn("seq", F.col("at") + last))


def wiped(tree: DataFrame, last: int) -> DataFrame:
    """All but the root is removed, at one number."""
    return _gone(tree.filter(F.col("id") != ROOT).select("id", F.lit(last + 1).cast("long").alias("seq")), "remove")


LAST = 10_000_000
_SHOWN = ("id", "parent", "name", "size", "mode", "content", "meta", "seq")


def _transplants(s: SparkSession, d: str) -> DataFrame:
    t = items(s, d)
    c = t.filter((F.col("id") >= 3 * LEVEL) & (F.col("id") < 4 * LEVEL) & (F.col("id") % 10 == 3)).select("id", (F.col("id") + 1).alias("source"))
    return applied(t, transplanted(t, c, LAST)).select(*_SHOWN)


def _moves(s: SparkSession, d: str) -> DataFrame:
    """Customers that change places in threes, and others that move to another nation or below themselves."""
    t = items(s, d)
    c = t.filter((F.col("id") >= 3 * LEVEL) & (F.col("id") < 4 * LEVEL)).select("id", "parent", "name")
    k = F.col("id") % 12
    other = c.select(F.col("id").alias("next"), F.col("parent").alias("its_parent"), F.col("name").alias("its_name"))
    asked = c.withColumn("next", F.when(k < 2, F.col("id") + 1).when(k == 2, F.col("id") - 2)).join(other, "next", "left")
    parent = F.when(k < 3, F.col("its_parent")).when(k == 3, F.col("id")).when(k == 4, 2 * LEVEL + F.col("id") % 25)
    asked = asked.withColumns({"parent": parent, "name": F.when(k < 3, F.col("its_name")).otherwise(F.concat("name", F.lit("+")))}).filter("parent IS NOT NULL").select("id", "parent", "name")
    return applied(t, moved(t, asked, LAST)).filter((F.col("id") >= 3 * LEVEL) & (F.col("id") < 4 * LEVEL)).select("id", "parent", "name", (F.col("meta") > LAST).alias("is_new"))


def _collapses(s: SparkSession, d: str) -> DataFrame:
    """Nations are collapsed and every other one opened again, without what lay deeper."""
    t = items(s, d)
    nations = t.filter((F.col("id") >= 2 * LEVEL) & (F.col("id") < 3 * LEVEL) & (F.col("id") % 4 == 1)).select("id")
    changes, cold = collapsed(t, nations, LAST)
    closed = stored(applied(t, changes), "closed")
    return applied(closed, expanded(closed, cold, nations.filter("id % 8 = 1"), 2 * LAST)).select(*_SHOWN)


def _wiped(s: SparkSession, d: str) -> DataFrame:
    t = items(s, d)
    changes = wiped(t, LAST)
    return changes.groupBy("seq", "op").agg(F.count("*").alias("n")).join(applied(t, changes.withColumns({c: F.lit(None) for c in COLUMNS if c not in ("seq", "id")})).agg(F.count("*").alias("left")), how="cross")


QUERIES = {"transplanted": _transplants, "moved_items": _moves, "collapsed_folders": _collapses, "wiped": _wiped}
_C = f"id >= {3 * LEVEL} AND id < {4 * LEVEL}"
ORACLE_SQL = {
    "transplanted": with_views(
        f""", p AS (SELECT a.id, b.id AS source, row_number() OVER (ORDER BY a.id) + {LAST} AS n FROM items a JOIN items b ON b.id = a.id + 1 WHERE a.id >= {3 * LEVEL} AND a.id < {4 * LEVEL} AND b.id < {4 * LEVEL} AND a.id % 10 = 3)
SELECT i.id, coalesce(k.id, i.parent) AS parent, i.name, coalesce(o.size, i.size) AS size, coalesce(o.mode, i.mode) AS mode, coalesce(p.n, i.content) AS content, CASE WHEN o.mode <> i.mode THEN p.n ELSE i.meta END AS meta, coalesce(p.n, k.n, i.seq) AS seq
FROM items i LEFT JOIN p ON p.id = i.id LEFT JOIN items o ON o.id = p.source LEFT JOIN p k ON k.source = i.parent WHERE i.id NOT IN (SELECT source FROM p)""", "items"
    ),
    "moved_items": with_views(
        f""", c AS (SELECT *, id % 12 AS k FROM items WHERE {_C}),
w AS (SELECT c.*, CASE WHEN c.k < 3 THEN n.parent WHEN c.k = 3 THEN c.id WHEN c.k = 4 THEN {2 * LEVEL} + c.id % 25 END AS to_parent, CASE WHEN c.k < 3 THEN n.name ELSE c.name || '+' END AS to_name, n.id AS nid FROM c LEFT JOIN c n ON n.id = CASE WHEN c.k < 2 THEN c.id + 1 WHEN c.k = 2 THEN c.id - 2 END),
g AS (SELECT *, CASE WHEN k = 4 THEN true WHEN k < 3 THEN id - k IN (SELECT id FROM c) AND id - k + 2 IN (SELECT id FROM c) ELSE false END AS goes FROM w)
SELECT id, CASE WHEN goes THEN to_parent ELSE parent END AS parent, CASE WHEN goes THEN to_name ELSE name END AS name, goes AS is_new FROM g""", "items"
    ),
    "collapsed_folders": with_views(
        f""", n AS (SELECT id, row_number() OVER (ORDER BY id) + {LAST} AS n FROM items WHERE id >= {2 * LEVEL} AND id < {3 * LEVEL} AND id % 4 = 1),
kids AS (SELECT i.*, row_number() OVER (ORDER BY i.id) + {2 * LAST} AS n FROM items i JOIN n ON n.id = i.parent WHERE n.id % 8 = 1)
SELECT i.id, i.parent, i.name, i.size, i.mode, i.content, i.meta, coalesce(kids.n, n.n, i.seq) AS seq FROM items i LEFT JOIN n ON n.id = i.id LEFT JOIN kids ON kids.id = i.id
WHERE kids.id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM closure x JOIN n y ON y.id = x.ancestor WHERE x.id = i.id AND x.distance > 0)""", "items", "closure"
    ),
    "wiped": with_views(f"SELECT CAST({LAST + 1} AS BIGINT) AS seq, 'remove' AS op, count(*) AS n, CAST(1 AS BIGINT) AS \"left\" FROM items WHERE id <> {ROOT}", "items"),
}
ORACLE_SQL = {k: q.replace(")\n, ", "),\n") for k, q in ORACLE_SQL.items()}
