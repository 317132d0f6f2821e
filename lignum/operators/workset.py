"""Working sets, listings and lookups: what a client holds, and what it must be told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.sources.relations import LEVEL, change_log, items, materialized, read, with_views


def held(tree: DataFrame, shown: DataFrame) -> DataFrame:
    """Items in the working set."""
    return tree.join(shown.select("id"), "id", "left_semi")


def listing(tree: DataFrame, folder: int, cursor: str, limit: int) -> DataFrame:
    """A page of a folder by name after ``cursor``; ``next`` is the cursor for more, null on the last page."""
    page = tree.filter((F.col("parent") == folder) & (F.col("name") > cursor)).orderBy("name").limit(limit + 1)
    at = F.row_number().over(Window.orderBy("name"))
    numbered = page.select("id", "name", at.alias("at"), F.count("*").over(Window.partitionBy()).alias("n"))
    kept = numbered.filter(F.col("at") <= limit)
    return kept.select("id", "name", F.when(F.col("n") > limit, F.max("name").over(Window.partitionBy())).alias("next"))


def lookup(tree: DataFrame, wanted: DataFrame, overrides: DataFrame) -> DataFrame:
    """The item of each ``parent, name``: by display name first, then by its real name."""
    shown = tree.join(overrides, "id").select("parent", F.col("display").alias("name"), F.col("id").alias("by_display"))
    real = tree.select("parent", "name", F.col("id").alias("by_name"))
    both = wanted.join(shown, ["parent", "name"], "left").join(real, ["parent", "name"], "left")
    return both.select("parent", "name", F.coalesce("by_display", "by_name").alias("id"))


def displayed(tree: DataFrame, overrides: DataFrame) -> DataFrame:
    return tree.join(overrides, "id", "left").select("id", F.coalesce("display", "name").alias("display"))


def same_identity(a: str, b: str) -> Column:
    """Device, inode and kind agree, and so does the birth time where both know it."""
    f = lambda side, c: F.col(f"{side}.{c}")
    born = (f(a, "born") == f(b, "born")) | f(a, "born").isNull() | f(b, "born").isNull()
    return (f(a, "dev") == f(b, "dev")) & (f(a, "ino") == f(b, "ino")) & (f(a, "kind") == f(b, "kind")) & born


def identified(seen: DataFrame, known: DataFrame) -> DataFrame:
    """For each row seen the known row of the same identity, the smallest id of several; null if none."""
    joined = seen.alias("s").join(known.alias("k"), same_identity("s", "k"), "left")
    return joined.groupBy(F.col("s.id").alias("seen")).agg(F.min("k.id").alias("known"))


def hard_links(nodes: DataFrame) -> DataFrame:
    """Items whose inode has other names, and how many."""
    n = nodes.groupBy("dev", "ino").agg(F.count("*").alias("names"))
    return nodes.join(n.filter("names > 1"), ["dev", "ino"]).select("id", (F.col("names") - 1).alias("others"))


def restored(cold: DataFrame, seen: DataFrame) -> DataFrame:
    """Children of a collapsed folder that keep their id: the same name and identity."""
    return cold.alias("c").join(seen.alias("s"), (F.col("c.name") == F.col("s.name")) & same_identity("c", "s")).select(F.col("c.id").alias("id"), F.col("s.id").alias("seen"))


def audited(index: DataFrame, live: DataFrame, columns: tuple[str, ...] = ("ino", "size", "mtime_ns", "ctime_ns")) -> DataFrame:
    """Files whose live state differs from the index; ids that only one side has aren't compared."""
    both = index.join(live.select("id", *[F.col(c).alias(f"live_{c}") for c in columns]), "id")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"live_{c}"))
    return both.filter(~same).select("id")


def entry(tree: DataFrame) -> DataFrame:
    """Rows as they are listed: ``id, kind, size, lazy``. Folders have size 0, links the bytes of their ``target``; folders not ``scanned`` yet are lazy."""
    size = F.when(F.col("kind") == "Dir", 0).when(F.col("kind") == "Symlink", F.coalesce(F.octet_length("target"), F.lit(0))).otherwise(F.col("size"))
    return tree.select("id", "kind", size.cast("long").alias("size"), ((F.col("kind") == "Dir") & ~F.coalesce("scanned", F.lit(False))).alias("lazy"))


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that one set has and the other lacks, with which."""
    added = after.select("id").exceptAll(before.select("id")).withColumn("change", F.lit("added"))
    return added.unionByName(before.select("id").exceptAll(after.select("id")).withColumn("change", F.lit("removed")))


def working_set(now: DataFrame, added: DataFrame, removed: DataFrame, full: bool = False) -> DataFrame:
    """The working set after a client's report: replaced if it is full, else changed."""
    kept = added.select("id") if full else now.select("id").subtract(removed.select("id")).union(added.select("id"))
    return kept.distinct()


def invalidations(known: DataFrame, current: DataFrame) -> DataFrame:
    """What a kernel must forget: entries whose name now leads elsewhere, attributes and content that changed."""
    now = current.select("parent", "name", F.col("id").alias("new_id"), F.col("meta").alias("new_meta"), F.col("content").alias("new_content"))
    both = known.join(now, ["parent", "name"], "left")
    what = F.when(F.col("new_id").isNull() | (F.col("new_id") != F.col("id")), "entry").when(~F.col("content").eqNullSafe(F.col("new_content")), "content").when(~F.col("meta").eqNullSafe(F.col("new_meta")), "attributes")
    return both.withColumn("forget", what).filter("forget IS NOT NULL").select("parent", "name", "forget")


def guard(removals: DataFrame, shown: DataFrame, share: float = 0.2, most: int = 1000, least: int = 32) -> DataFrame:
    """Whether removals of held items are so many that the stream must wait: ``n, held, trips``."""
    n = removals.join(shown.select("id"), "id", "left_semi").agg(F.count("*").alias("n"))
    one = n.join(shown.agg(F.count("*").alias("held")), how="cross")  # one row each
    return one.select("n", "held", ((F.col("n") > most) | ((F.col("n") > least) & (F.col("n") > share * F.col("held")))).alias("trips"))


def scan_wanted(folders: DataFrame, lazy: tuple[str, ...]) -> DataFrame:
    """Folders with whether they are scanned at once, or why not: a mount, a lazy name, a parent listed on demand."""
    up = folders.select(F.col("id").alias("parent"), F.col("dev").alias("parent_dev"), F.col("expanded").alias("parent_expanded"))
    both = folders.join(up, "parent", "left")
    kind = F.when(F.col("dev") != F.coalesce("parent_dev", "dev"), "mount").when(F.coalesce("parent_expanded", F.lit(False)), "below lazy").when(F.col("name").isin(*lazy), "lazy").otherwise("scan")
    return both.select("id", kind.alias("kind"))


def presented(tree: DataFrame, overrides: DataFrame, parents: DataFrame) -> DataFrame:
    """Items as clients see them: folders have size 0, display names are overridden, writability comes from the folder."""
    up = parents.select(F.col("id").alias("parent"), (F.col("access").bitwiseAND(2) != 0).alias("writable"))
    both = tree.join(overrides, "id", "left").join(up, "parent", "left")
    return both.select("id", F.coalesce("display", "name").alias("display"), F.when(F.col("kind") == "Dir", 0).otherwise(F.col("size")).cast("long").alias("size"), F.coalesce("writable", F.lit(True)).alias("writable"))


def _overrides(s, d):
    return items(s, d).filter("kind = 'Dir' AND id % 4 = 0 AND parent IS NOT NULL").select("id", F.concat("name", F.lit(" 2")).alias("display"))


def _nodes(s: SparkSession, d: str, shift: int) -> DataFrame:
    o = read(s, d, "orders")
    born = F.when((F.col("o_orderkey") + shift) % 5 != 0, F.col("o_orderkey") % 13 + F.when(F.col("o_orderkey") % 29 == 0, shift).otherwise(0))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "Dir").otherwise("File")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("dev"), F.floor(F.col("o_orderkey") / 3).alias("ino"), kind.alias("kind"), born.alias("born"), F.col("o_orderpriority").alias("name"))


def _changed(s, d):
    """The tree later on: some items renamed, removed or changed."""
    t = items(s, d).filter("id % 31 <> 0")
    return t.withColumn("meta", F.when(F.col("id") % 7 == 0, F.col("meta") + 1).otherwise(F.col("meta"))).withColumn("content", F.when(F.col("id") % 10 == 0, F.col("content") + 1).otherwise(F.col("content"))).withColumn("size", F.when(F.col("id") % 9 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("name", F.when(F.col("id") % 23 == 0, F.concat("name", F.lit("~"))).otherwise(F.col("name")))


def _folders(s, d):
    t = items(s, d).filter("kind = 'Dir'")
    name = F.when(F.col("id") % 8 == 0, "target").otherwise(F.col("name"))
    return t.select("id", "parent", name.alias("name"), F.when((F.col("id") >= 3 * LEVEL) & (F.col("id") % 50 == 0), 2).otherwise(1).alias("dev"), ((F.col("id") < 3 * LEVEL) & (F.col("id") % 9 == 0)).alias("expanded"))


def _wanted(s, d):
    t = items(s, d).filter("kind = 'Dir' AND parent IS NOT NULL")
    return t.select("parent", "name").union(_overrides(s, d).join(t, "id").select("parent", F.col("display").alias("name"))).union(t.select("parent", F.concat("name", F.lit("?"))))


_ASIA = LEVEL + 2
QUERIES = {
    "held_items": lambda s, d: held(items(s, d), materialized(s, d)).select("id", "name"),
    "listing_page": lambda s, d: listing(items(s, d), 2 * LEVEL + 3, "Customer#000000100", 10),
    "listing_last_page": lambda s, d: listing(items(s, d), _ASIA, "", 50),
    "lookups": lambda s, d: lookup(items(s, d), _wanted(s, d), _overrides(s, d)),
    "displayed": lambda s, d: displayed(items(s, d), _overrides(s, d)),
    "identified": lambda s, d: identified(_nodes(s, d, 0), _nodes(s, d, 2)),
    "hard_links": lambda s, d: hard_links(_nodes(s, d, 0)),
    "restored_children": lambda s, d: restored(_nodes(s, d, 0), _nodes(s, d, 1)),
    "audited": lambda s, d: audited(items(s, d).withColumns({"ino": F.col("id"), "ctime_ns": F.col("mtime_ns")}), _changed(s, d).withColumns({"ino": F.col("id") + F.when(F.col("id") % 37 == 0, 1).otherwise(0), "ctime_ns": F.when(F.col("id") % 41 == 0, F.lit(None)).otherwise(F.col("mtime_ns"))})),
    "entries": lambda s, d: entry(items(s, d).withColumns({"kind": F.when(F.col("id") % 6 == 5, "Symlink").otherwise(F.col("kind")), "target": F.concat(F.lit("\u00e9/"), "name"), "scanned": F.when(F.col("id") % 4 != 0, F.col("id") % 4 == 1)})),
    "mount_changes": lambda s, d: set_changes(items(s, d).filter("id % 6 = 0"), items(s, d).filter("id % 4 = 0")),
    "working_set": lambda s, d: working_set(materialized(s, d), items(s, d).filter("id % 17 = 0"), items(s, d).filter("id % 3 = 0")),
    "invalidations": lambda s, d: invalidations(items(s, d).filter("parent IS NOT NULL").select("parent", "name", "id", "meta", "content"), _changed(s, d)),
    "mass_delete_guard": lambda s, d: guard(items(s, d).filter("id % 10 < 4").select("id"), materialized(s, d)),
    "scan_wanted": lambda s, d: scan_wanted(_folders(s, d), ("target", ".git")),
    "presented": lambda s, d: presented(items(s, d), _overrides(s, d), items(s, d)),
    "held_changes": lambda s, d: change_log(s, d).select("id").distinct().intersect(s.range(40).select("id")),
}
_OVER = "overrides AS (SELECT id, name || ' 2' AS display FROM items WHERE kind = 'Dir' AND id % 4 = 0 AND parent IS NOT NULL)"
_N = "(SELECT o_orderkey AS id, o_orderkey % 2 AS dev, o_orderkey // 3 AS ino, CASE WHEN o_orderkey % 3 = 0 THEN 'Dir' ELSE 'File' END AS kind, CASE WHEN (o_orderkey + {0}) % 5 <> 0 THEN o_orderkey % 13 + CASE WHEN o_orderkey % 29 = 0 THEN {0} ELSE 0 END END AS born, o_orderpriority AS name FROM orders)"
_SAME = "{0}.dev = {1}.dev AND {0}.ino = {1}.ino AND {0}.kind = {1}.kind AND ({0}.born = {1}.born OR {0}.born IS NULL OR {1}.born IS NULL)"
_CHANGED = """changed AS (SELECT id, parent, CASE WHEN id % 23 = 0 THEN name || '~' ELSE name END AS name, mtime_ns, CASE WHEN id % 9 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN id % 7 = 0 THEN meta + 1 ELSE meta END AS meta,
  CASE WHEN id % 10 = 0 THEN content + 1 ELSE content END AS content FROM items WHERE id % 31 <> 0)"""
ORACLE_SQL = {
    "held_items": with_views("SELECT id, name FROM items WHERE id IN (SELECT id FROM materialized)", "items", "materialized"),
    "listing_page": with_views(
        f", p AS (SELECT id, name, row_number() OVER (ORDER BY name) AS k FROM items WHERE parent = {2 * LEVEL + 3} AND name > 'Customer#000000100') SELECT id, name, CASE WHEN (SELECT count(*) FROM p) > 10 THEN (SELECT max(name) FROM p WHERE k <= 10) END AS next FROM p WHERE k <= 10", "items"
    ),
    "listing_last_page": with_views(f"SELECT id, name, CAST(NULL AS VARCHAR) AS next FROM items WHERE parent = {_ASIA}", "items"),
    "lookups": with_views(
        f""", {_OVER}, t AS (SELECT * FROM items WHERE kind = 'Dir' AND parent IS NOT NULL), w AS (SELECT parent, name FROM t UNION ALL SELECT parent, display FROM overrides JOIN t USING (id) UNION ALL SELECT parent, name || '?' FROM t)
SELECT w.parent, w.name, coalesce((SELECT i.id FROM items i JOIN overrides o ON o.id = i.id WHERE i.parent = w.parent AND o.display = w.name), (SELECT i.id FROM items i WHERE i.parent = w.parent AND i.name = w.name)) AS id FROM w""", "items"
    ),
    "displayed": with_views(f", {_OVER} SELECT id, coalesce(display, name) AS display FROM items LEFT JOIN overrides USING (id)", "items"),
    "identified": f"SELECT s.id AS seen, min(k.id) AS known FROM {_N.format(0)} s LEFT JOIN {_N.format(2)} k ON {_SAME.format('s', 'k')} GROUP BY 1",
    "hard_links": f"SELECT id, n - 1 AS others FROM (SELECT id, count(*) OVER (PARTITION BY dev, ino) AS n FROM {_N.format(0)} x) WHERE n > 1",
    "restored_children": f"SELECT c.id, s.id AS seen FROM {_N.format(0)} c JOIN {_N.format(1)} s ON c.name = s.name AND {_SAME.format('c', 's')}",
    "audited": with_views(f", {_CHANGED} SELECT i.id FROM items i JOIN changed c USING (id) WHERE i.size <> c.size OR i.id % 37 = 0 OR i.id % 41 = 0", "items"),
    "entries": with_views("SELECT id, k AS kind, CAST(CASE k WHEN 'Dir' THEN 0 WHEN 'Symlink' THEN strlen('\u00e9/' || name) ELSE size END AS BIGINT) AS size, k = 'Dir' AND id % 4 <> 1 AS lazy FROM (SELECT *, CASE WHEN id % 6 = 5 THEN 'Symlink' ELSE kind END AS k FROM items)", "items"),
    "mount_changes": with_views("SELECT id, 'added' AS change FROM items WHERE id % 4 = 0 AND id % 6 <> 0 UNION ALL SELECT id, 'removed' FROM items WHERE id % 6 = 0 AND id % 4 <> 0", "items"),
    "working_set": with_views("SELECT id FROM materialized WHERE id % 3 <> 0 UNION SELECT id FROM items WHERE id % 17 = 0", "items", "materialized"),
    "invalidations": with_views(
        f""", {_CHANGED} SELECT * FROM (SELECT i.parent, i.name, CASE WHEN c.id IS NULL OR c.id <> i.id THEN 'entry' WHEN c.content <> i.content THEN 'content' WHEN c.meta <> i.meta THEN 'attributes' END AS forget
FROM items i LEFT JOIN changed c ON c.parent = i.parent AND c.name = i.name WHERE i.parent IS NOT NULL) WHERE forget IS NOT NULL""", "items"
    ),
    "mass_delete_guard": with_views(", h AS (SELECT count(*) FILTER (WHERE id % 10 < 4) AS n, count(*) AS held FROM materialized) SELECT n, held, n > 1000 OR (n > 32 AND n > 0.2 * held) AS trips FROM h", "items", "materialized"),
    "scan_wanted": with_views(
        f""", f AS (SELECT id, parent, CASE WHEN id % 8 = 0 THEN 'target' ELSE name END AS name, CASE WHEN id >= {3 * LEVEL} AND id % 50 = 0 THEN 2 ELSE 1 END AS dev, id < {3 * LEVEL} AND id % 9 = 0 AS expanded FROM items WHERE kind = 'Dir')
SELECT f.id, CASE WHEN f.dev <> coalesce(p.dev, f.dev) THEN 'mount' WHEN coalesce(p.expanded, false) THEN 'below lazy' WHEN f.name IN ('target', '.git') THEN 'lazy' ELSE 'scan' END AS kind FROM f LEFT JOIN f p ON p.id = f.parent""", "items"
    ),
    "presented": with_views(
        f", {_OVER} SELECT i.id, coalesce(display, i.name) AS display, CAST(CASE WHEN i.kind = 'Dir' THEN 0 ELSE i.size END AS BIGINT) AS size, coalesce(p.access & 2 <> 0, true) AS writable FROM items i LEFT JOIN overrides o ON o.id = i.id LEFT JOIN items p ON p.id = i.parent", "items"
    ),
    "held_changes": with_views("SELECT DISTINCT id FROM change_log WHERE id BETWEEN 0 AND 39", "change_log"),
}
ORACLE_SQL = {k: q.replace(")\n, ", "),\n") for k, q in ORACLE_SQL.items()}
