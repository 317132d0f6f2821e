"""How items are shown: links, executable bits, capabilities, access, modes and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.operators.tree import closure
from lignum.session import hot_join
from lignum.sources.relations import LEVEL, items, read, with_views

#: Access bits, and bits of what may be done with an item.
READ, WRITE, EXECUTE = 1, 2, 4
CAN = {"read": 1, "write": 2, "enumerate": 4, "add": 8, "rename": 16, "reparent": 32, "delete": 64}


def link_shown(target: Column, depth: Column, root: Column) -> Column:
    """A link's target as shown, or null if it leads out of the root.

    Absolute targets in the root become relative ones. A target is some ``../``, no more than the link's
    folder is deep, then at least one component, none of them empty, ``.`` or ``..``.
    """
    base = F.regexp_replace(root, "/+$", "")
    inner = F.when(base == "", F.substr(target, F.lit(2))).when(F.startswith(target, F.concat(base, F.lit("/"))) & F.startswith(base, F.lit("/")), F.substr(target, F.length(base) + 2))
    shown = F.when(F.startswith(target, F.lit("/")), F.concat(F.repeat(F.lit("../"), depth), inner)).otherwise(target)
    ups = F.length(F.regexp_extract(shown, r"^((?:\.\./)*)", 1)) / 3
    rest = F.regexp_replace(shown, r"^(?:\.\./)*", "")
    sound = (ups <= depth) & (rest != "") & ~F.exists(F.split(rest, "/", -1), lambda c: c.isin("", ".", ".."))
    return F.when(sound, shown)


def normalized(path: Column, base: Column) -> Column:
    """An absolute path without dots from ``path`` seen from ``base``; null above the root."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, F.lit("/"), path))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        up = c == ".."
        stack = F.when(c.isin("", "."), acc["stack"]).when(up, F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["stack"], c))
        return F.struct(stack.alias("stack"), (acc["ok"] & ~(up & (F.size(acc["stack"]) == 0))).alias("ok"))

    done = F.aggregate(F.split(whole, "/", -1), start, step)
    return F.when(done["ok"], F.concat(F.lit("/"), F.array_join(done["stack"], "/")))


def may_execute(name: Column, above: Column) -> Column:
    """Whether a file may show as executable. ``above`` holds its folders' names, outermost first, joined by /."""
    script = F.lower(name).rlike(r"\.(command|tool|terminal)$")
    bundle = F.lower(F.concat(F.lit("/"), above, F.lit("/"))).rlike(r"\.app/contents/macos/")
    return ~script & ~bundle


def capabilities(kind: Column, access: Column, blocked: Column, is_root: Column, parent_access: Column) -> Column:
    has = lambda bits: access.bitwiseAND(bits) != 0
    bit = lambda name, when: F.when(when, CAN[name]).otherwise(0)
    is_dir, is_file = kind == "Dir", kind == "File"
    free = ~is_root & F.coalesce(parent_access.bitwiseAND(WRITE) != 0, F.lit(True))
    return (
        bit("enumerate", is_dir & has(READ | EXECUTE))
        + bit("add", is_dir & has(WRITE) & has(EXECUTE))
        + bit("read", ~is_dir & (has(READ) | blocked | (kind == "Symlink")))
        + bit("write", is_file & has(WRITE) & ~blocked)
        + F.when(free, CAN["rename"] + CAN["reparent"] + CAN["delete"]).otherwise(0)
    )


def access_of(mode: Column, uid: Column, gid: Column, is_dir: Column, user: int, groups: tuple[int, ...]) -> Column:
    """Access bits by the one class of mode bits that applies; the superuser may do all but execute what nobody may."""
    if user == 0:
        return F.lit(READ | WRITE) + F.when(is_dir | (mode.bitwiseAND(0o111) != 0), EXECUTE).otherwise(0)
    bits = F.when(uid == user, F.shiftright(mode, 6)).when(gid.isin(*groups), F.shiftright(mode, 3)).otherwise(mode)
    on = lambda b: bits.bitwiseAND(b) != 0
    return F.when(on(4), READ).otherwise(0) + F.when(on(2), WRITE).otherwise(0) + F.when(on(1), EXECUTE).otherwise(0)


def with_execute(mode: Column, execute: Column) -> Column:
    """Mode bits with execution for all who may read, or for none."""
    readable = F.shiftright(mode.bitwiseAND(0o444), 2)
    return F.when(execute, mode.bitwiseOR(readable)).otherwise(mode.bitwiseAND(0o7666))


def mode_text(mode: Column) -> Column:
    parts = []
    for shift in (6, 3, 0):
        for bit, letter in ((4, "r"), (2, "w"), (1, "x")):
            parts.append(F.when(F.shiftright(mode, shift).bitwiseAND(bit) != 0, letter).otherwise("-"))
    return F.concat(*parts)


def time_text(ns: Column) -> Column:
    """UTC, to the minute; rounds down, also before 1970."""
    return F.date_format(F.timestamp_seconds(F.floor(ns / 1_000_000_000)), "yyyy-MM-dd HH:mm")


def ls_line(kind: Column, mode: Column, size: Column, ns: Column, name: Column) -> Column:
    letter = F.when(kind == "Dir", "d").when(kind == "Symlink", "l").otherwise("-")
    return F.concat(letter, mode_text(mode), F.lit(" "), F.lpad(size.cast("string"), 12, " "), F.lit(" "), time_text(ns), F.lit(" "), name)


def address_class(ip: Column) -> Column:
    """private, shared (carrier) or public for an IPv4 address; null if it isn't one."""
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    private = ip.rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")
    shared = ip.rlike(r"^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.")
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.when(private, "private").when(shared, "shared").otherwise("public"))


def remote_target(text: Column) -> Column:
    """``[user@]host:path`` as a struct; null if there is no path."""
    rx = r"^(?:([^@:/]+)@)?([^@:/]+):(.+)$"
    part = lambda i: F.regexp_extract(text, rx, i)
    return F.when(text.rlike(rx), F.struct(F.nullif(part(1), F.lit("")).alias("user"), part(2).alias("host"), part(3).alias("path")))


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(https?://[^\s\"'<>)]+)", 1), F.lit(""))


def anchor_hex(replica: Column, seq: Column) -> Column:
    """24 bytes as hex: the replica's 16 and the sequence number."""
    return F.concat(F.lower(replica), F.lpad(F.lower(F.hex(seq)), 16, "0"))


def anchor_seq(anchor: Column) -> Column:
    """The sequence number of an anchor; null if it isn't one."""
    good = F.length(anchor) == 48
    return F.when(good, F.conv(F.substr(anchor, F.lit(33)), 16, 10).cast("long"))


def masked(current: Column, new: Column, changed: Column, bit: int) -> Column:
    """The new value of a field where its bit says that it changed."""
    return F.when(changed.bitwiseAND(bit) != 0, new).otherwise(current)


def execute_verdicts(tree: DataFrame) -> DataFrame:
    """Files with whether they may show as executable, by all folders above them."""
    up = hot_join(closure(tree).filter("distance > 0"), tree.select(F.col("id").alias("ancestor"), F.col("name").alias("folder")), "ancestor")
    outermost = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "folder")))
    above = up.groupBy("id").agg(F.array_join(F.transform(outermost, lambda x: x["folder"]), "/").alias("above"))
    return tree.filter("kind = 'File'").join(above, "id", "left").select("id", may_execute(F.col("name"), F.coalesce("above", F.lit(""))).alias("may_execute"))


def _links(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders")
    t = F.element_at(F.array(*[F.lit(x) for x in ("a/b", "../x", "../../x/y", "/srv/data/a", "/srv/data", "/srv/other/a", "./b", "a//b", "..", "a/../b", "../", "/srv/data/../x")]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return o.select("o_orderkey", t.alias("target"), (F.col("o_orderkey") % 4).cast("int").alias("depth"))


def _renamed(s: SparkSession, d: str) -> DataFrame:
    """The tree with bundle names on some levels."""
    t = items(s, d)
    nation, region = (F.col("id") >= 2 * LEVEL) & (F.col("id") < 3 * LEVEL), (F.col("id") >= LEVEL) & (F.col("id") < 2 * LEVEL)
    customer = (F.col("id") >= 3 * LEVEL) & (F.col("id") < 4 * LEVEL)
    name = F.when(region, F.concat("name", F.lit(".App"))).when(nation & (F.col("id") % 3 == 0), "Contents").when(customer & (F.col("id") % 2 == 0), "MacOS").when(F.col("id") % 17 == 0, F.lit("run.COMMAND")).otherwise(F.col("name"))
    return t.withColumn("name", name)


def _parents(s, d):
    t = items(s, d)
    return t.join(t.select(F.col("id").alias("parent"), F.col("access").alias("parent_access")), "parent", "left")


QUERIES = {
    "links_shown": lambda s, d: _links(s, d).select("o_orderkey", link_shown(F.col("target"), F.col("depth"), F.lit("/srv/data/")).alias("shown")),
    "paths_normalized": lambda s, d: _links(s, d).select("o_orderkey", normalized(F.col("target"), F.lit("/home")).alias("path")),
    "execute_verdicts": lambda s, d: execute_verdicts(_renamed(s, d)),
    "capabilities": lambda s, d: _parents(s, d).select("id", capabilities(F.col("kind"), F.col("access"), F.col("seq") % 6 == 0, F.col("parent").isNull(), F.col("parent_access")).alias("caps")),
    "access_bits": lambda s, d: items(s, d).select("id", access_of(F.col("mode"), F.col("seq") % 3, F.col("seq") % 4, F.col("kind") == "Dir", 1, (1, 2)).alias("user"), access_of(F.col("mode"), F.col("seq") % 3, F.col("seq") % 4, F.col("kind") == "Dir", 0, ()).alias("root")),
    "execute_applied": lambda s, d: items(s, d).select("id", with_execute(F.col("mode"), F.col("seq") % 2 == 0).alias("mode")),
    "ls_lines": lambda s, d: items(s, d).select("id", ls_line(F.col("kind"), F.col("mode"), F.col("size"), (F.col("mtime_ns") - 5_000_000_000) * 100_000, F.col("name")).alias("line")),
    "address_classes": lambda s, d: read(s, d, "orders").select("o_orderkey", address_class(F.concat_ws(".", (F.col("o_orderkey") % 260).cast("string"), (F.col("o_custkey") % 256).cast("string"), F.lit("0.1"))).alias("kind")),
    "remote_targets": lambda s, d: read(s, d, "customer").select("c_custkey", remote_target(F.concat(F.when(F.col("c_custkey") % 2 == 0, "me@").otherwise(""), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(":/srv/x"))).alias("t")).select("c_custkey", "t.user", "t.host", "t.path"),
    "urls_found": lambda s, d: read(s, d, "pages").select("page_id", first_url(F.concat(F.lit("see ("), "url", F.lit(") for it"))).alias("url")),
    "anchors": lambda s, d: read(s, d, "orders").select("o_orderkey", anchor_hex(F.md5(F.lit("replica").cast("binary")), F.col("o_orderkey")).alias("anchor")).withColumn("seq", anchor_seq(F.col("anchor"))),
    "local_fields_merged": lambda s, d: items(s, d).select("id", masked(F.col("name"), F.lit("new"), F.col("access"), 1).alias("name"), masked(F.col("size"), F.col("seq"), F.col("access"), 4).alias("size")),
}
_LINKS = """WITH l AS (SELECT o_orderkey, ['a/b', '../x', '../../x/y', '/srv/data/a', '/srv/data', '/srv/other/a', './b', 'a//b', '..', 'a/../b', '../', '/srv/data/../x'][CAST(o_orderkey % 12 AS INTEGER) + 1] AS target, CAST(o_orderkey % 4 AS INTEGER) AS depth FROM orders)"""
ORACLE_SQL = {
    "links_shown": _LINKS + """ SELECT o_orderkey, CASE target WHEN 'a/b' THEN 'a/b' WHEN '../x' THEN CASE WHEN depth >= 1 THEN target END WHEN '../../x/y' THEN CASE WHEN depth >= 2 THEN target END
  WHEN '/srv/data/a' THEN repeat('../', depth) || 'a' END AS shown FROM l""",
    "paths_normalized": _LINKS + """ SELECT o_orderkey, CASE target WHEN 'a/b' THEN '/home/a/b' WHEN '../x' THEN '/x' WHEN '/srv/data/a' THEN '/srv/data/a' WHEN '/srv/data' THEN '/srv/data' WHEN '/srv/other/a' THEN '/srv/other/a' WHEN './b' THEN '/home/b'
  WHEN 'a//b' THEN '/home/a/b' WHEN '..' THEN '/' WHEN 'a/../b' THEN '/home/b' WHEN '../' THEN '/' WHEN '/srv/data/../x' THEN '/srv/x' END AS path FROM l""",
    "execute_verdicts": with_views(
        f""", c AS (SELECT o.id, o.id % 17 = 0 AS script, p.id % 2 = 0 AS macos, q.id % 3 = 0 AS contents FROM items o JOIN items p ON p.id = o.parent JOIN items q ON q.id = p.parent WHERE o.id >= 4 * {LEVEL})
SELECT id, NOT script AND NOT (macos AND contents) AS may_execute FROM c""", "items"
    ).replace(")\n, c", "),\nc"),
    "capabilities": with_views(
        """SELECT i.id, CASE WHEN i.kind = 'Dir' AND i.access & 5 <> 0 THEN 4 ELSE 0 END + CASE WHEN i.kind = 'Dir' AND i.access & 2 <> 0 AND i.access & 4 <> 0 THEN 8 ELSE 0 END
  + CASE WHEN i.kind = 'File' AND (i.access & 1 <> 0 OR i.seq % 6 = 0) THEN 1 ELSE 0 END + CASE WHEN i.kind = 'File' AND i.access & 2 <> 0 AND i.seq % 6 <> 0 THEN 2 ELSE 0 END
  + CASE WHEN i.parent IS NOT NULL AND p.access & 2 <> 0 THEN 112 ELSE 0 END AS caps FROM items i LEFT JOIN items p ON p.id = i.parent""", "items"
    ),
    "access_bits": with_views(
        """SELECT id, CASE WHEN bits & 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN bits & 2 <> 0 THEN 2 ELSE 0 END + CASE WHEN bits & 1 <> 0 THEN 4 ELSE 0 END AS user, 3 + CASE WHEN kind = 'Dir' OR mode & 73 <> 0 THEN 4 ELSE 0 END AS root
FROM (SELECT *, CASE WHEN seq % 3 = 1 THEN mode >> 6 WHEN seq % 4 IN (1, 2) THEN mode >> 3 ELSE mode END AS bits FROM items)""", "items"
    ),
    "execute_applied": with_views("SELECT id, CASE WHEN seq % 2 = 0 THEN mode | ((mode & 292) >> 2) ELSE mode & 3510 | (mode & 438) END AS mode FROM items", "items"),
    "ls_lines": with_views(
        """SELECT id, CASE WHEN kind = 'Dir' THEN 'd' ELSE '-' END || (SELECT string_agg(CASE WHEN mode & b <> 0 THEN l ELSE '-' END, '' ORDER BY b DESC) FROM (VALUES (256, 'r'), (128, 'w'), (64, 'x'), (32, 'r'), (16, 'w'), (8, 'x'), (4, 'r'), (2, 'w'), (1, 'x')) m(b, l))
  || ' ' || lpad(CAST(size AS VARCHAR), 12, ' ') || ' ' || strftime(make_timestamp(CAST(floor((mtime_ns - 5000000000) * 100000.0 / 1000000000) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M') || ' ' || name AS line FROM items""", "items"
    ),
    "address_classes": """SELECT o_orderkey, CASE WHEN a > 255 THEN NULL WHEN a IN (10, 127) OR (a = 169 AND b = 254) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) THEN 'private' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'shared' ELSE 'public' END AS kind
FROM (SELECT o_orderkey, o_orderkey % 260 AS a, o_custkey % 256 AS b FROM orders)""",
    "remote_targets": """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'me' END AS user, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS host, CASE WHEN c_custkey % 3 <> 0 THEN '/srv/x' END AS path FROM customer""",
    "urls_found": "SELECT page_id, url FROM pages",
    "anchors": "SELECT o_orderkey, md5('replica') || lpad(lower(to_hex(o_orderkey)), 16, '0') AS anchor, o_orderkey AS seq FROM orders",
    "local_fields_merged": with_views("SELECT id, CASE WHEN access & 1 <> 0 THEN 'new' ELSE name END AS name, CASE WHEN access & 4 <> 0 THEN seq ELSE size END AS size FROM items", "items"),
}
