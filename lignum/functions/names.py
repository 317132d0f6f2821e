"""Names of items: extensions, numbered and conflict names, validity, folding and collisions.

Limits are in UTF-8 bytes; names are cut at the border of a character.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lignum.operators.log import numbered as numbered_rows
from lignum.session import stored
from lignum.sources.relations import read, with_views

LONGEST, LONGEST_EXT, LONGEST_CLIENT = 255, 32, 32
#: Folder names that are listed only on demand.
LAZY = ("node_modules", ".git", "target", ".venv", "venv", "__pycache__", ".next", "dist", "build", ".cache", ".gradle", ".tox", ".mypy_cache", ".pytest_cache")
#: The word in display names of colliding items.
MARKER = "copy"
#: What staging files begin with, unless a caller says otherwise.
STAGING = ".staging-"


def cut(text: Column, most: Column | int) -> Column:
    """The longest prefix of at most so many bytes, ending between characters."""
    most = F.greatest(F.lit(most) if isinstance(most, int) else most, F.lit(0))
    data = text.cast("binary")
    # A character has 4 bytes at most, and all but its first are 80 to BF.
    within = lambda k: F.substr(data, most + k, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    back = F.when(~within(1), 0).when(~within(0), 1).when(~within(-1), 2).otherwise(3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substr(data, F.lit(1), most - back).cast("string"))


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(name)))


def extension(name: Column) -> Column:
    """With its dot; empty for names that start with their only dot or end with one."""
    return F.regexp_extract(name, r"^(?s:.)+?(\.[^.]+)$", 1)


def numbered(name: Column, n: Column) -> Column:
    """``stem N.ext`` for N of 2 and more; the stem gives way."""
    return F.when(n <= 1, name).otherwise(_fitted(name, F.concat(F.lit(" "), n.cast("string"))))


def marked(name: Column | str, n: Column, marker: str = MARKER) -> Column:
    """``stem (marker N).ext``."""
    name = F.col(name) if isinstance(name, str) else name
    return _fitted(name, F.concat(F.lit(f" ({marker} "), n.cast("string"), F.lit(")")))


def _fitted(name: Column, tag: Column) -> Column:
    ext = extension(name)
    return F.concat(cut(stem(name), F.lit(LONGEST) - F.octet_length(tag) - F.octet_length(ext)), tag, ext)


def is_bounce(name: Column, candidate: Column) -> Column:
    """Whether the candidate is ``stem N.ext`` of the name, with N of 1 to 4 digits and at least 2."""
    tail = F.substr(candidate, F.length(stem(name)) + 1, F.length(candidate))
    digits = F.regexp_extract(F.substr(tail, F.lit(1), F.length(tail) - F.length(extension(name))), "^ ([0-9]{1,4})$", 1)
    fits = F.startswith(candidate, stem(name)) & F.endswith(tail, extension(name)) & (F.length(tail) >= F.length(extension(name)))
    return fits & (digits != "") & (F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0)) >= 2)


def conflict_name(name: Column, client: Column, stamp: Column, n: Column) -> Column:
    """``stem (conflict from client stamp)[ N].ext``, the extension cut to 32 bytes and the stem to what is left."""
    dot = F.regexp_extract(name, r"^(?s:.)+?(\.[^.]*)$", 1)
    own = F.substr(name, F.lit(1), F.length(name) - F.length(dot))
    ext = cut(dot, LONGEST_EXT)
    tag = F.concat(F.lit(" (conflict from "), client, F.lit(" "), stamp, F.lit(")"), F.when(n > 1, F.concat(F.lit(" "), n.cast("string"))).otherwise(""))
    return F.concat(cut(own, F.lit(LONGEST) - F.octet_length(tag) - F.octet_length(ext)), tag, ext)


def conflict_base(name: Column) -> Column:
    """The name that a conflict copy was made of; others as they are."""
    return F.regexp_replace(name, r" \(conflict from [^)]* [0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}\.[0-9]{2}\)( [0-9]+)?(?=(\.[^.]*)?$)", "")


def numbered_base(name: Column) -> Column:
    return F.regexp_replace(name, r" [0-9]{1,4}(?=(\.[^.]+)?$)", "")


def display_base(name: Column, marker: str = MARKER) -> Column:
    """The name that ``stem (marker N).ext`` shows; null for others."""
    own = F.regexp_extract(stem(name), rf"^((?s:.)*) \({marker} [0-9]+\)$", 1)
    return F.when(stem(name).rlike(rf" \({marker} [0-9]+\)$"), F.concat(own, extension(name)))


def client_name(name: Column) -> Column:
    """Without slashes and control characters, at most 32 bytes, trimmed; ``mac`` if nothing is left."""
    clean = F.regexp_replace(cut(F.regexp_replace(name, r"[/\p{Cc}]", ""), LONGEST_CLIENT), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return F.when(clean == "", "mac").otherwise(clean)


def is_valid(name: Column) -> Column:
    return (name != "") & ~name.isin(".", "..") & (F.octet_length(name) <= LONGEST) & ~name.rlike(r"[/\x00]")


def is_local_only(name: Column) -> Column:
    return name.isin(".DS_Store", ".localized", "Icon\r") | F.startswith(name, F.lit("._")) | F.endswith(name, F.lit(".nosync"))


def is_lazy(name: Column, names: tuple[str, ...] = LAZY) -> Column:
    return name.isin(*names)


def is_ignored(name: Column, prefix: str = STAGING) -> Column:
    """Staging files, whose prefix is followed by 32 hexadecimal digits of either case and anything, and remains of network file systems."""
    digits = F.substring(name, len(prefix) + 1, 32)
    return (F.startswith(name, F.lit(prefix)) & digits.rlike(r"^[0-9a-fA-F]{32}$")) | F.startswith(name, F.lit(".nfs"))


@F.pandas_udf(StringType())
def fold_key(names: pd.Series) -> pd.Series:
    """Names that differ by case or composition only have the same key: decomposed, case-folded, decomposed."""
    nfd = lambda x: unicodedata.normalize("NFD", x)
    return names.map(lambda x: None if x is None else x.lower() if x.isascii() else nfd(nfd(x).casefold()))


@F.pandas_udf(StringType())
def for_terminal(names: pd.Series) -> pd.Series:
    """Control and bidirectional characters as escapes."""
    odd = lambda c: unicodedata.category(c) == "Cc" or c in "؜‎‏‪‫‬‭‮⁦⁧⁨⁩"
    return names.map(lambda x: None if x is None else "".join(f"\\u{{{ord(c):x}}}" if odd(c) else c for c in x))


def display_names(names: DataFrame, marker: str = MARKER) -> DataFrame:
    """``parent, id, name, display``: of names in a folder with one key, the first in byte order stays and others are numbered from 2.

    A number whose own key is taken in the folder by a name is skipped. Names are numbered in ranges of the order of
    folder, key and name. The k-th of a group gets the k-th number from 2 that isn't taken, so only the numbers that are taken
    for a group's own key come to its rows. Groups whose names are so long that they give way to the number reach Python, a
    group in one frame: such names differ in how they are cut.
    """
    keyed = stored(names.select("parent", "id", "name", fold_key("name").alias("key"), F.xxhash64("id").alias("salt")), "keyed")
    sizes = keyed.groupBy("parent", "key").agg(F.count("*").alias("size"), F.max(F.octet_length("name")).alias("longest"), F.max(F.octet_length("key")).alias("key_bytes"))
    sizes = stored(sizes.filter("size > 1").withColumn("long", F.greatest("longest", "key_bytes") > LONGEST - len(f" ({marker} )") - 20), "groups")
    # Names that look like a numbered display of a group's key take that number.
    base = display_base(F.col("key"), marker.lower())
    number = F.regexp_extract(stem(F.col("key")), rf" \({marker.lower()} ([1-9][0-9]{{0,17}})\)$", 1)
    taken = keyed.select("parent", base.alias("base"), F.nullif(number, F.lit("")).cast("long").alias("n")).filter("base IS NOT NULL AND n >= 2")
    taken = taken.groupBy("parent", F.col("base").alias("key")).agg(F.sort_array(F.collect_set("n")).alias("taken"))
    groups = keyed.join(sizes.filter("NOT long").select("parent", "key"), ["parent", "key"])
    placed = stored(numbered_rows(groups, "parent", "key", "name", "salt").select("parent", "key", "id", "name", "at"), "placed")
    first = placed.groupBy("parent", "key").agg(F.min("at").alias("first"))
    whole = placed.join(first, ["parent", "key"]).join(taken, ["parent", "key"], "left")
    k = F.col("at") - F.col("first") + 1
    n = F.when(k > 1, F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), k, lambda acc, t: acc + F.when(t <= acc, 1).otherwise(0)))
    short = whole.select("parent", "id", "name", F.coalesce(marked("name", n, marker), F.col("name")).alias("display"))
    alone = keyed.join(sizes.select("parent", "key"), ["parent", "key"], "left_anti").select("parent", "id", "name", F.col("name").alias("display"))
    held = keyed.filter(F.col("key").contains(f" ({marker.lower()} ")).groupBy("parent").agg(F.collect_set("key").alias("taken"))
    long = keyed.join(sizes.filter("long").select("parent", "key"), ["parent", "key"]).join(held, "parent", "left").select("parent", "key", "id", "name", "taken")

    def number_long(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name", key=lambda s: s.map(str.encode))
        used = set(pdf["taken"].iloc[0]) if pdf["taken"].iloc[0] is not None else set()
        out, n = [], 2
        for k, name in enumerate(pdf["name"]):
            display = name
            while k and (display is name or _key(display) in used):
                display, n = _marked(name, n, marker), n + 1
            used.add(_key(display))
            out.append(display)
        return pdf[["parent", "id", "name"]].assign(display=out)

    return alone.unionByName(short).unionByName(long.groupBy("parent", "key").applyInPandas(number_long, alone.schema))


def _key(name: str) -> str:
    return name.lower() if name.isascii() else unicodedata.normalize("NFD", unicodedata.normalize("NFD", name).casefold())


def _marked(name: str, n: int, marker: str) -> str:
    at = name.rfind(".")
    own, ext = (name[:at], name[at:]) if 0 < at < len(name) - 1 else (name, "")
    tag = f" ({marker} {n})"
    room = max(0, LONGEST - len(tag.encode()) - len(ext.encode()))
    return own.encode()[:room].decode(errors="ignore") + tag + ext


def _names(s: SparkSession, d: str) -> DataFrame:
    """Part names with every kind of ending."""
    p = read(s, d, "part")
    k = F.col("p_partkey") % 9
    end = F.when(k == 0, ".txt").when(k == 1, "").when(k == 2, ".").when(k == 3, " 2.txt").when(k == 4, ".tar.gz").when(k == 5, " 1234").when(k == 6, " (conflict from mac 2024-01-02 03.04) 2.txt").when(k == 7, ".command").otherwise(" 1.md")
    lead = F.when(F.col("p_partkey") % 10 == 0, ".").when(F.col("p_partkey") % 25 == 1, F.repeat(F.lit("long "), F.lit(60))).otherwise("")
    return p.select("p_partkey", F.concat(lead, "p_name", end).alias("name"))


def _twins(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "part")
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.initcap("p_name")).otherwise(F.col("p_name"))
    return p.select((F.col("p_partkey") % 40).alias("parent"), F.col("p_partkey").alias("id"), F.concat(name, F.lit(".txt")).alias("name")).groupBy("parent", "name").agg(F.min("id").alias("id")).select("parent", "id", "name")


def _copies(s: SparkSession, d: str) -> DataFrame:
    """Twins beside names that look like a numbered twin."""
    t = _twins(s, d)
    k = F.col("id") % 3
    more = t.filter("id % 5 = 0").select("parent", (F.col("id") + 10_000_000).alias("id"), marked(F.lower(F.col("name")), 2 + k).alias("name"))
    return t.unionByName(more).dropDuplicates(["parent", "name"])


def _columns(s, d):
    n = _names(s, d)
    name, k = F.col("name"), (F.col("p_partkey") % 12).cast("int")
    return n.select(
        "p_partkey", stem(name).alias("stem"), extension(name).alias("ext"), numbered(name, k).alias("numbered"), marked(name, k).alias("marked"),
        conflict_name(name, F.lit("desk"), F.lit("2024-05-06 07.08"), k).alias("conflict"), conflict_base(name).alias("conflict_base"), numbered_base(name).alias("numbered_base"),
        is_valid(name).alias("valid"), is_local_only(name).alias("local_only"), is_lazy(name).alias("lazy"), is_ignored(name).alias("ignored"),
    )


QUERIES = {
    "name_parts": lambda s, d: _columns(s, d),
    "name_bounces": lambda s, d: _names(s, d).select("p_partkey", is_bounce(F.col("name"), numbered(F.col("name"), (F.col("p_partkey") % 5).cast("int"))).alias("bounce")),
    "client_names": lambda s, d: read(s, d, "customer").select("c_custkey", client_name(F.concat(F.lit("/ "), "c_name", F.lit("\t"), "c_mktsegment", F.lit(" end of it"))).alias("client")),
    "fold_keys": lambda s, d: read(s, d, "documents").select("doc_id", fold_key("text").alias("key")),
    "terminal_names": lambda s, d: read(s, d, "part").select("p_partkey", for_terminal(F.concat("p_name", F.lit("\t"))).alias("shown")),
    "display_names": lambda s, d: display_names(_copies(s, d)).select("parent", "name", "display"),
    "display_bases": lambda s, d: _copies(s, d).select("parent", "name", display_base(F.col("name")).alias("base")).distinct(),
}
_NAMES = """names AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '.' WHEN p_partkey % 25 = 1 THEN repeat('long ', 60) ELSE '' END || p_name || CASE p_partkey % 9 WHEN 0 THEN '.txt' WHEN 1 THEN '' WHEN 2 THEN '.' WHEN 3 THEN ' 2.txt'
  WHEN 4 THEN '.tar.gz' WHEN 5 THEN ' 1234' WHEN 6 THEN ' (conflict from mac 2024-01-02 03.04) 2.txt' WHEN 7 THEN '.command' ELSE ' 1.md' END AS name, CAST(p_partkey % 12 AS INTEGER) AS k FROM part),
parts AS (SELECT *, regexp_extract(name, '^.+?(\\.[^.]+)$', 1) AS ext, regexp_extract(name, '^.+?(\\.[^.]*)$', 1) AS dot FROM names),
stems AS (SELECT *, substr(name, 1, length(name) - length(ext)) AS stem, substr(name, 1, length(name) - length(dot)) AS own, substr(dot, 1, 32) AS dot32, ' (conflict from desk 2024-05-06 07.08)' || CASE WHEN k > 1 THEN ' ' || k ELSE '' END AS tag FROM parts)"""
ORACLE_SQL = {
    # All of these names are ASCII, where bytes and characters agree.
    "name_parts": f"""WITH {_NAMES} SELECT p_partkey, stem, ext, CASE WHEN k <= 1 THEN name ELSE substr(stem, 1, 255 - length(' ' || k) - length(ext)) || ' ' || k || ext END AS numbered,
  substr(stem, 1, 255 - length(' ({MARKER} ' || k || ')') - length(ext)) || ' ({MARKER} ' || k || ')' || ext AS marked, substr(own, 1, 255 - length(tag) - length(dot32)) || tag || dot32 AS conflict,
  CASE WHEN p_partkey % 9 = 6 THEN replace(name, ' (conflict from mac 2024-01-02 03.04) 2', '') ELSE name END AS conflict_base, regexp_replace(name, ' [0-9]{{1,4}}(\\.[^.]+)?$', '\\1') AS numbered_base,
  name <> '' AND name NOT IN ('.', '..') AND length(name) <= 255 AS valid, false AS local_only, false AS lazy, false AS ignored FROM stems""",
    "name_bounces": f"WITH {_NAMES} SELECT p_partkey, p_partkey % 5 >= 2 AND length(stem) + length(ext) <= 253 AS bounce FROM stems",
    "client_names": "SELECT c_custkey, trim(substr(' ' || c_name || c_mktsegment || ' end of it', 1, 32)) AS client FROM customer",
    "display_names": f"""WITH {{c}}, k AS (SELECT *, lower(name) AS key, row_number() OVER (PARTITION BY parent, lower(name) ORDER BY name) AS k FROM c),
free AS (SELECT g.parent, g.key, r.range AS n, row_number() OVER (PARTITION BY g.parent, g.key ORDER BY r.range) + 1 AS k FROM (SELECT parent, key, count(*) AS size FROM k GROUP BY 1, 2 HAVING count(*) > 1) g, range(2, 60) r
  WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.parent = g.parent AND x.key = replace(g.key, '.txt', '') || ' ({MARKER} ' || r.range || ').txt'))
SELECT k.parent, name, CASE WHEN k.k = 1 THEN name ELSE substr(name, 1, length(name) - 4) || ' ({MARKER} ' || n || ')' || right(name, 4) END AS display FROM k LEFT JOIN free USING (parent, key, k)""",
    "display_bases": f"WITH {{c}} SELECT parent, name, CASE WHEN regexp_matches(name, ' \\({MARKER} [0-9]+\\)\\.txt$') THEN regexp_replace(name, ' \\({MARKER} [0-9]+\\)', '') END AS base FROM c",
}
_COPIES = f"""t AS (SELECT p_partkey % 40 AS parent, p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE p_name END || '.txt' AS name FROM part),
c AS (SELECT DISTINCT parent, name FROM (SELECT parent, name FROM t UNION ALL SELECT parent, lower(substr(name, 1, length(name) - 4)) || ' ({MARKER} ' || (2 + id % 3) || ').txt' FROM t WHERE id % 5 = 0 AND id IN (SELECT min(id) FROM t GROUP BY parent, name)))"""
ORACLE_SQL = {k: q.replace("{c}", _COPIES) for k, q in ORACLE_SQL.items()}
