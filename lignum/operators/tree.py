"""Trees given by parent pointers: paths, closures, subtrees.

Walks double their reach with each join, so a tree of depth d takes log2(d) rounds and no row's walk
is followed one step at a time. A walk starts from the rows asked for only. Each round is written to the
shared folder, so plans don't grow, and a walk ends when a round adds nothing or only cycles are left.
Paths end at 4096 levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.operators.log import change_log, numbered, tombstones
from lignum.session import DEPTH, hot_join, stored
from lignum.sources.relations import LEVEL, ROOT, VIEWS, folders_shown, items, materialized, with_views


def paths(tree: DataFrame, root: int = ROOT, deepest: int = DEPTH) -> DataFrame:
    """Adds ``path`` and ``depth``: names below the root joined with /; null if detached or too deep.

    ``tree`` has ``id, parent, name``. Each round a folder holds its names up to ``top`` and takes over what
    its top holds; folders that have come to the end are set aside.
    """
    at_root = F.col("id") == root
    rows = tree.filter("id IS NOT NULL").withColumn("_top", F.when(~at_root, F.col("parent")))
    own = F.when(at_root, F.lit("")).otherwise(F.col("name"))
    joined = F.when(F.coalesce(F.col("above") != "", F.lit(False)), F.concat("above", F.lit("/"), "path")).otherwise(F.col("path"))
    # Only folders are walked up; in the end each row takes over what its folder holds.
    folders = rows.join(rows.select(F.col("_top").alias("id")).distinct(), "id", "left_semi")
    walk = stored(folders.select("id", F.col("_top").alias("top"), own.alias("path"), F.when(at_root, 0).otherwise(1).alias("depth")), "paths")
    whole, going = walk.filter("top IS NULL"), walk.filter("top IS NOT NULL")
    for _ in range(deepest.bit_length()):
        up = whole.union(going).select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("path").alias("above"), F.col("depth").alias("more"))
        # A row whose top isn't there is detached, and goes.
        walk = stored(hot_join(going, up, "top").select("id", F.col("next").alias("top"), joined.alias("path"), (F.col("depth") + F.col("more")).alias("depth")), "paths")
        ended, going = walk.filter("top IS NULL"), walk.filter("top IS NOT NULL")
        if ended.isEmpty():
            break  # only cycles are left, and what lies below them or detached rows
        whole = whole.union(ended)
        if going.isEmpty():
            break
    up = whole.filter(F.col("depth") < 1 << deepest.bit_length()).select(F.col("id").alias("_top"), F.col("path").alias("above"), F.col("depth").alias("more"))
    found = hot_join(rows, up, "_top", "left").withColumn("path", own)
    held = F.col("_top").isNull() | F.col("more").isNotNull()
    depth = F.when(at_root, 0).otherwise(1) + F.coalesce("more", F.lit(0))
    names = [c for c in tree.columns if c != "id"]
    return found.select("id", *names, F.when(held, joined).alias("path"), F.when(held, depth).alias("depth"))


def _walk(tree: DataFrame, reach: DataFrame, down: bool) -> DataFrame:
    """Extends ``id, ancestor, distance`` to all ancestors of each ``id``, or down to all that lie below each ``ancestor``.

    A round joins what has been reached with the pointers of twice the distance. Items on a cycle or below
    one have no root: of what lies above or below them only they themselves are given. Any depth is
    followed: ancestors of an item with 2n levels above it include items with n to 2n, so once a round
    leaves as many pointers as it found, all that are left belong to cycles.
    """
    jump = stored(tree.filter("parent IS NOT NULL").select("id", F.col("parent").alias("up")), "jumps")
    parts, step = [stored(reach.select("id", "ancestor", F.col("distance").cast("int").alias("distance")), "reach")], 1
    left = jump.count()
    while True:
        known, met = parts[0], parts[0].limit(0)
        for more in parts[1:]:
            known, met = known.union(more), met.union(more)
        if down:
            more = hot_join(jump, known.select(F.col("id").alias("up"), "ancestor", "distance"), "up").select("id", "ancestor", (F.col("distance") + step).alias("distance"))
        else:
            more = hot_join(known, jump.select(F.col("id").alias("ancestor"), "up"), "ancestor", counted=met).select("id", F.col("up").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        more = stored(more, "reach")
        if more.isEmpty():
            return known
        parts.append(more)
        jump = stored(hot_join(jump, jump.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")), "jumps")
        before, left = left, jump.count()
        if left == before:
            break
        step *= 2
    known = parts[0]
    for more in parts[1:]:
        known = known.union(more)
    endless = jump.select("id").distinct()
    return known.join(endless, "id", "left_anti").union(parts[0].join(endless, "id", "left_semi"))


def _themselves(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))


def closure(tree: DataFrame) -> DataFrame:
    """``id, ancestor, distance`` of every row and each of its ancestors, itself included at 0.

    The table has as many rows as the tree has levels for each item; :func:`above` and :func:`subtree` take less.
    """
    return _walk(tree, _themselves(tree), down=False)


def above(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """The closure of the items ``ids`` only."""
    return _walk(tree, _themselves(tree.join(ids.select("id").distinct(), "id", "left_semi")), down=False)


def child_counts(tree: DataFrame) -> DataFrame:
    return tree.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children"))


def subtree(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Items at or below any of ``roots`` (``id``): ``id, root, distance``."""
    start = _themselves(tree.join(roots.select("id").distinct(), "id", "left_semi"))
    return _walk(tree, start, down=True).select("id", F.col("ancestor").alias("root"), "distance")


def with_ancestors(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` and all their ancestors, once each."""
    return above(tree, ids).select(F.col("ancestor").alias("id")).distinct()


def would_cycle(tree: DataFrame, proposals: DataFrame) -> DataFrame:
    """For proposed moves ``id, parent``: whether the new parent lies in the item's own subtree."""
    up = above(tree, proposals.select(F.col("parent").alias("id"))).select(F.col("id").alias("parent"), F.col("ancestor").alias("id"), F.lit(True).alias("hit"))
    return proposals.join(up, ["id", "parent"], "left").select("id", "parent", F.coalesce("hit", F.lit(False)).alias("cycle"))


def remove_subtree(tree: DataFrame, roots: DataFrame, seq: int) -> DataFrame:
    """Tombstones of removed subtrees, all at one sequence number."""
    gone = subtree(tree, roots).select("id").distinct()
    return tree.join(gone, "id", "left_semi").select("id", F.col("parent").alias("old_parent"), F.lit(seq).cast("long").alias("seq"))


def drop_order(tree: DataFrame, candidates: DataFrame, keep: DataFrame) -> DataFrame:
    """Candidates and what lies below them, except ``keep`` and its ancestors; deepest first, then by id, numbered from 1."""
    gone = subtree(tree, candidates).select("id").distinct().join(with_ancestors(tree, keep), "id", "left_anti")
    gone = stored(gone, "gone")
    deep = above(tree, gone).groupBy("id").agg(F.max("distance").alias("depth"))
    return numbered(deep, F.desc("depth"), F.asc("id")).select("id", "depth", "at")


def held_below(tree: DataFrame, roots: DataFrame, held: DataFrame) -> DataFrame:
    """How many held items each root has at or below it: ``root, held``."""
    return subtree(tree, roots).join(held.select("id"), "id", "left_semi").groupBy("root").agg(F.countDistinct("id").alias("held"))


def breadth_first(tree: DataFrame) -> DataFrame:
    """All items that hang together with the root, parents before children: ``id, depth, at``."""
    return numbered(paths(tree).filter("depth IS NOT NULL").select("id", "depth"), "depth", "id").select("id", "depth", "at")


def ancestor_names(tree: DataFrame) -> DataFrame:
    """The names above each item, nearest first and the root's own last, joined with <; not of the root, nor of what doesn't hang together with it."""
    deep = paths(tree).filter("depth > 0")
    parts = F.split("path", "/")
    return deep.select("id", F.array_join(F.concat(F.reverse(F.slice(parts, 1, F.size(parts) - 1)), F.array(F.lit(""))), "<").alias("above"))


def resolve(tree: DataFrame, wanted: DataFrame, overrides: DataFrame | None = None, root: int = ROOT) -> DataFrame:
    """The item at each path, or null: ``path, id``. Walks down from the root, a step a component, from the wanted paths only.

    Names are those shown: ``overrides`` (``id, display``) go before real ones, which count where nothing is shown under a name.
    """
    shown = tree.select("parent", "name", F.col("id").alias("real"))
    if overrides is not None:
        shown = shown.unionByName(tree.join(overrides, "id").select("parent", F.col("display").alias("name"), F.col("id").alias("first")), allowMissingColumns=True)
    else:
        shown = shown.withColumn("first", F.lit(None).cast("long"))
    at = wanted.select("path").distinct().select("path", F.lit(root).cast("long").alias("id"), F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/")).alias("parts"))
    at, k = stored(at, "resolve"), 0
    most = at.agg(F.max(F.size("parts"))).first()[0] or 0
    if most > DEPTH:
        raise ValueError(f"a path has more than {DEPTH} components")
    while k < most:
        going = at.filter(F.size("parts") > k).select("path", F.col("id").alias("parent"), "parts", F.get("parts", F.lit(k)).alias("name"))
        step = going.join(shown, ["parent", "name"], "left").groupBy("path").agg(F.first("parts").alias("parts"), F.min("first").alias("first"), F.min("real").alias("real"))
        at = stored(at.filter(F.size("parts") <= k).unionByName(step.select("path", F.coalesce("first", "real").alias("id"), "parts")), "resolve")
        k += 1
    return wanted.join(at.select("path", "id"), "path", "left").select("path", "id")


def tombstones_reported(tombs: DataFrame, shown: DataFrame, rounds: int = 64) -> DataFrame:
    """Tombstones that a client hears of: its own id is shown, or its folder is, or the folder's own later tombstone is reported.

    ``tombs`` has ``id, seq, old_parent``, one for each id. Pointers to the folder's later tombstone double their
    reach each round, and what is reported flows down them. Sequence numbers grow along a chain, so it ends.
    """
    t = tombs.select("id", "seq", "old_parent")
    own = t.join(shown.select("id", F.lit(True).alias("a")), "id", "left").join(shown.select(F.col("id").alias("old_parent"), F.lit(True).alias("b")), "old_parent", "left")
    own = own.select("id", "seq", "old_parent", (F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("said"))
    later = t.select(F.col("id").alias("old_parent"), F.col("seq").alias("later"))
    state = own.join(later, "old_parent", "left").select("id", "seq", "old_parent", "said", F.when(F.col("later") > F.col("seq"), F.col("old_parent")).alias("up"))
    state = stored(state, "reported")
    for _ in range(rounds):
        if state.filter("up IS NOT NULL").isEmpty():
            return state.filter("said").select("id", "seq", "old_parent")
        above = state.select(F.col("id").alias("up"), F.col("said").alias("above"), F.col("up").alias("far"))
        state = stored(state.join(above, "up", "left").select("id", "seq", "old_parent", (F.col("said") | F.coalesce("above", F.lit(False))).alias("said"), F.col("far").alias("up")), "reported")
    raise RuntimeError(f"chains of tombstones did not end in {rounds} rounds")


def _roots(s, d):
    return items(s, d).filter(f"id BETWEEN {2 * LEVEL} AND {2 * LEVEL + 4}").select("id")


def _some_paths(s, d):
    return s.createDataFrame([("ASIA",), ("ASIA/CHINA",), ("EUROPE/FRANCE/nobody",), ("",), ("AMERICA/no",)], "path string")


def _renamed_nations(s, d):
    return items(s, d).filter(f"id >= {2 * LEVEL} AND id < {3 * LEVEL} AND id % 3 = 0").select("id", F.concat("name", F.lit(" 2")).alias("display"))


def _shown_paths(s, d):
    """Paths of all customers, through nations by shown or real names."""
    t = items(s, d)
    up = lambda n: t.select(F.col("id").alias(f"{n}"), F.col("name").alias(f"{n}_name"), F.col("parent").alias(f"{n}_parent"))
    c = t.filter(f"id >= {3 * LEVEL} AND id < {4 * LEVEL}").join(up("n"), F.col("parent") == F.col("n")).join(up("r"), F.col("n_parent") == F.col("r"))
    return c.select(F.concat_ws("/", "r_name", F.concat("n_name", F.when(F.col("id") % 4 == 0, " 2").otherwise("")), "name").alias("path"))


def _proposals(s, d):
    t = items(s, d).filter("kind = 'Dir' AND parent IS NOT NULL")
    return t.filter(f"id >= {3 * LEVEL} AND id % 7 = 0").select(F.col("parent").alias("id"), F.col("id").alias("parent")).union(t.filter("id % 5 = 1").select("id", "parent"))


def _tombs(s, d):
    """Tombstones whose folder may itself be a removed item."""
    return tombstones(change_log(s, d)).select("id", "seq", F.when(F.col("id") % 3 == 0, F.col("old_parent")).otherwise(F.col("id") + 1).alias("old_parent"))


QUERIES = {
    "tree_paths": lambda s, d: paths(items(s, d)).select("id", "path", F.col("depth").cast("int").alias("depth")),
    "tree_closure": lambda s, d: closure(items(s, d)),
    "child_counts": lambda s, d: child_counts(items(s, d)),
    "subtree_sizes": lambda s, d: closure(items(s, d)).join(items(s, d).select("id", "size"), "id").groupBy("ancestor").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")),
    "with_ancestors": lambda s, d: with_ancestors(items(s, d), items(s, d).filter("id % 11 = 0").select("id")),
    "would_cycle": lambda s, d: would_cycle(items(s, d), _proposals(s, d)),
    "remove_subtree": lambda s, d: remove_subtree(items(s, d), _roots(s, d), 99),
    "drop_order": lambda s, d: drop_order(items(s, d), _roots(s, d), items(s, d).filter("id % 13 = 0").select("id")),
    "held_below": lambda s, d: held_below(items(s, d), items(s, d).filter(f"id < {3 * LEVEL}").select("id"), materialized(s, d)),
    "breadth_first": lambda s, d: breadth_first(items(s, d)),
    "ancestor_names": lambda s, d: ancestor_names(items(s, d)),
    "resolve_paths": lambda s, d: resolve(items(s, d), _some_paths(s, d)),
    "resolve_shown": lambda s, d: resolve(items(s, d), _shown_paths(s, d), _renamed_nations(s, d)),
    "tombstones_reported": lambda s, d: tombstones_reported(_tombs(s, d), folders_shown(s)),
}
_TREE = ("items", "closure")
_GONE = f"SELECT DISTINCT id FROM closure WHERE ancestor BETWEEN {2 * LEVEL} AND {2 * LEVEL + 4}"
ORACLE_SQL = {
    "tree_paths": with_views("SELECT id, path, depth FROM paths", "items", "paths"),
    "tree_closure": with_views("SELECT id, ancestor, distance FROM closure", *_TREE),
    "child_counts": with_views("SELECT parent, count(*) AS children FROM items WHERE parent IS NOT NULL GROUP BY 1", "items"),
    "subtree_sizes": with_views("SELECT ancestor, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM closure JOIN items USING (id) GROUP BY 1", *_TREE),
    "with_ancestors": with_views("SELECT DISTINCT ancestor AS id FROM closure WHERE id % 11 = 0", *_TREE),
    "would_cycle": with_views(
        f""", proposals AS (SELECT parent AS id, id AS parent FROM items WHERE kind = 'Dir' AND parent IS NOT NULL AND id >= {3 * LEVEL} AND id % 7 = 0
UNION ALL SELECT id, parent FROM items WHERE kind = 'Dir' AND parent IS NOT NULL AND id % 5 = 1)
SELECT p.id, p.parent, EXISTS (SELECT 1 FROM closure c WHERE c.id = p.parent AND c.ancestor = p.id) AS cycle FROM proposals p""",
        *_TREE,
    ),
    "remove_subtree": with_views(f"SELECT id, parent AS old_parent, CAST(99 AS BIGINT) AS seq FROM items WHERE id IN ({_GONE})", *_TREE),
    "drop_order": with_views(
        f"""SELECT id, depth, row_number() OVER (ORDER BY depth DESC, id) AS at FROM (SELECT id, max(distance) AS depth FROM closure
WHERE id IN ({_GONE}) AND id NOT IN (SELECT ancestor FROM closure WHERE id % 13 = 0) GROUP BY id)""",
        *_TREE,
    ),
    "held_below": with_views(f"SELECT ancestor AS root, count(DISTINCT id) AS held FROM closure WHERE ancestor < {3 * LEVEL} AND id IN (SELECT id FROM materialized) GROUP BY 1", *_TREE, "materialized"),
    "breadth_first": with_views("SELECT id, depth, row_number() OVER (ORDER BY depth, id) AS at FROM (SELECT id, max(distance) AS depth FROM closure GROUP BY id)", *_TREE),
    "ancestor_names": with_views("SELECT c.id, string_agg(i.name, '<' ORDER BY c.distance) AS above FROM closure c JOIN items i ON i.id = c.ancestor WHERE distance > 0 GROUP BY 1", *_TREE),
    "resolve_paths": with_views(
        """SELECT w.path, p.id FROM (VALUES ('ASIA'), ('ASIA/CHINA'), ('EUROPE/FRANCE/nobody'), (''), ('AMERICA/no')) w(path) LEFT JOIN paths p ON p.path = w.path""", "items", "paths"
    ),
    "resolve_shown": with_views(
        f""", c AS (SELECT r.name || '/' || n.name || CASE WHEN c.id % 4 = 0 THEN ' 2' ELSE '' END || '/' || c.name AS path, CASE WHEN c.id % 4 <> 0 OR n.id % 3 = 0 THEN c.id END AS id FROM items c JOIN items n ON n.id = c.parent JOIN items r ON r.id = n.parent WHERE c.id >= {3 * LEVEL} AND c.id < {4 * LEVEL})
SELECT path, id FROM c""", "items"
    ).replace(")\n, c AS", "),\nc AS"),
    "tombstones_reported": f"""WITH RECURSIVE change_log AS ({VIEWS["change_log"]}),
tombs AS (SELECT id, seq, CASE WHEN id % 3 = 0 THEN old_parent ELSE id + 1 END AS old_parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, op = 'remove' DESC) AS r,
  last_value(parent IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS old_parent FROM change_log) WHERE r = 1 AND op = 'remove'),
said AS (SELECT id, seq, old_parent FROM tombs WHERE id < 4 OR old_parent < 4
UNION SELECT t.id, t.seq, t.old_parent FROM tombs t JOIN said s ON t.old_parent = s.id AND s.seq > t.seq)
SELECT id, seq, old_parent FROM said""",
}
ORACLE_SQL = {k: q.replace(")\n, proposals", "),\nproposals") for k, q in ORACLE_SQL.items()}
