"""Items as clients see them: links relative to the root, rights, execution, display names and fields kept locally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.functions.rules import _renamed, capabilities, link_shown, may_execute
from lignum.operators.tree import paths
from lignum.sources.relations import LEVEL, ROOT, with_views

#: Owner's execution, of mode bits.
OWNER_EXECUTES = 0o100


def presentation(tree: DataFrame, overrides: DataFrame, local: DataFrame, root_path: str | None, expose: bool, root: int = ROOT) -> DataFrame:
    """Each item as it is shown: ``id, kind, size, target, display, caps, blocked, executable`` and the fields of ``local``.

    ``tree`` has ``id, parent, name, kind, size, mode, access, target``, ``overrides`` ``id, display`` and
    ``local`` ``id, hidden`` with any other fields, one row an item at most in both. A link shows its target
    as seen from its folder, with its bytes as size. One that leads out of the root, has no target, or
    whose folder hangs on no root is blocked: it stays a link, shows the target as stored, and is read as a
    file of that text. With ``expose`` a file whose owner may execute it is executable unless its name or
    the folders above forbid it. The root keeps its own name. Items without local fields aren't hidden and
    have nulls for the others. An empty tree gives no rows.

    Folders' paths are found once; each item then meets its folder in one join.
    """
    folders = paths(tree.filter("kind = 'Dir'").select("id", "parent", "name", "access"), root)
    up = folders.select(F.col("id").alias("parent"), F.col("path").alias("above"), F.col("depth").alias("up_depth"), F.col("access").alias("up_access"))
    fields = [c for c in local.columns if c not in ("id", "hidden")]
    kept = local.select("id", *[F.col(c).alias(f"local_{c}") for c in ("hidden", *fields)])
    own = tree.select("id", "parent", "name", "kind", "size", "mode", "access", F.coalesce("target", F.lit("")).alias("stored"))
    both = own.join(up, "parent", "left").join(overrides.select("id", "display"), "id", "left").join(kept, "id", "left")
    is_link, is_root = F.col("kind") == "Symlink", F.col("id") == root
    both = both.withColumn("shown", F.when(is_link, link_shown(F.col("stored"), F.col("up_depth"), F.lit(root_path).cast("string"))))
    both = both.withColumn("blocked", is_link & F.col("shown").isNull())
    target = F.when(is_link, F.coalesce("shown", "stored"))
    executable = F.lit(expose) & (F.col("kind") == "File") & (F.col("mode").bitwiseAND(OWNER_EXECUTES) != 0) & may_execute(F.col("name"), F.coalesce("above", F.lit("")))
    return both.select(
        "id", "kind", F.when(is_link, F.octet_length(target)).otherwise(F.col("size")).cast("long").alias("size"), target.alias("target"),
        F.when(is_root, F.col("name")).otherwise(F.coalesce("display", "name")).alias("display"),
        capabilities(F.col("kind"), F.col("access"), F.col("blocked"), is_root, F.when(~is_root, F.col("up_access"))).alias("caps"),
        "blocked", executable.alias("executable"), F.coalesce("local_hidden", F.lit(False)).alias("hidden"), *[F.col(f"local_{c}").alias(c) for c in fields],
    )


TARGETS = ("a/b", "../x", "../../x/y", "/srv/data/é", "/srv/data", "/srv/other/a", "./b", "a//b", "..", "../../../x", "../../../../x", "/srv/data/../x")


def _tree(s: SparkSession, d: str) -> DataFrame:
    """The tree with bundles, links to all sorts of targets, and files that their owners execute."""
    t = _renamed(s, d).withColumn("kind", F.when((F.col("kind") == "File") & (F.col("id") % 6 == 5), "Symlink").otherwise(F.col("kind")))
    target = F.element_at(F.array(*[F.lit(x) for x in TARGETS]), (F.floor(F.col("id") / 6) % 12 + 1).cast("int"))
    mode = F.when(F.col("id") % 4 < 3, F.col("mode").bitwiseOR(OWNER_EXECUTES)).otherwise(F.col("mode"))
    return t.withColumns({"target": F.when(F.col("id") % 7 != 0, target), "mode": mode})


def _presentation(s: SparkSession, d: str) -> DataFrame:
    t = _tree(s, d)
    overrides = t.filter("id % 10 = 1").select("id", F.concat("name", F.lit(" 2")).alias("display"))
    local = t.filter("id % 9 = 0").select("id", (F.col("id") % 2 == 0).alias("hidden"), (F.col("id") % 5).alias("favorite_rank"), (F.col("mtime_ns") + 1).alias("last_used_ns"))
    return presentation(t, overrides, local, "/srv/data", True)


QUERIES = {"presentation": _presentation}
ORACLE_SQL = {
    "presentation": with_views(
        f""", r AS (SELECT *, id // {LEVEL} AS lvl, CASE WHEN id // {LEVEL} = 1 THEN name || '.App' WHEN id // {LEVEL} = 2 AND id % 3 = 0 THEN 'Contents' WHEN id // {LEVEL} = 3 AND id % 2 = 0 THEN 'MacOS'
  WHEN id % 17 = 0 THEN 'run.COMMAND' ELSE name END AS named, CASE WHEN kind = 'File' AND id % 6 = 5 THEN 'Symlink' ELSE kind END AS k, coalesce(CASE WHEN id % 7 <> 0 THEN [{", ".join(f"'{t}'" for t in TARGETS)}][CAST(id // 6 % 12 AS INTEGER) + 1] END, '') AS stored FROM items),
l AS (SELECT *, CASE WHEN k = 'Symlink' THEN CASE stored WHEN '/srv/data/é' THEN '../../../é' WHEN 'a/b' THEN stored WHEN '../x' THEN stored WHEN '../../x/y' THEN stored WHEN '../../../x' THEN stored END END AS shown FROM r),
b AS (SELECT *, k = 'Symlink' AND shown IS NULL AS blocked, CASE WHEN k = 'Symlink' THEN coalesce(shown, stored) END AS target FROM l)
SELECT b.id, b.k AS kind, CAST(CASE WHEN b.k = 'Symlink' THEN strlen(b.target) ELSE b.size END AS BIGINT) AS size, b.target, CASE WHEN b.id <> {ROOT} AND b.id % 10 = 1 THEN b.named || ' 2' ELSE b.named END AS display,
  CASE WHEN b.k = 'Dir' AND b.access & 5 <> 0 THEN 4 ELSE 0 END + CASE WHEN b.k = 'Dir' AND b.access & 2 <> 0 AND b.access & 4 <> 0 THEN 8 ELSE 0 END
  + CASE WHEN b.k = 'Symlink' OR (b.k = 'File' AND b.access & 1 <> 0) THEN 1 ELSE 0 END + CASE WHEN b.k = 'File' AND b.access & 2 <> 0 THEN 2 ELSE 0 END
  + CASE WHEN p.access & 2 <> 0 THEN 112 ELSE 0 END AS caps, b.blocked,
  b.k = 'File' AND b.id % 4 < 3 AND b.named <> 'run.COMMAND' AND NOT (p.id % 2 = 0 AND q.id % 3 = 0) AS executable,
  CASE WHEN b.id % 9 = 0 THEN b.id % 2 = 0 ELSE false END AS hidden, CASE WHEN b.id % 9 = 0 THEN b.id % 5 END AS favorite_rank, CASE WHEN b.id % 9 = 0 THEN b.mtime_ns + 1 END AS last_used_ns
FROM b LEFT JOIN items p ON p.id = b.parent LEFT JOIN items q ON q.id = p.parent""", "items"
    ).replace(")\n, r", "),\nr"),
}
