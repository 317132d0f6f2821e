"""The prefix trie of conversations by prefix-doubling naming.

Every distinct turn gets a dense number. Blocks of 2, 4, 8 ... turns that begin at a multiple of their
length get a number for each distinct pair of the numbers of their halves, so equal blocks have equal
numbers, and a level has half the rows of the one below. A prefix of d turns is the blocks of the bits of
d, the longest first; going down the levels, a prefix that has the level's bit gets the number of the pair
of what it has so far and its block there. So all prefixes of a conversation of n turns are named from 4n
rows in 2 log n rounds, and two prefixes of one length have one number exactly if their turns are equal.
A node of the trie is a length and a number.

The smallest conversation of a node stands for it. From there on it stands for all its longer prefixes, so
a sum over a node's subtree is, over its members, the sum of what each stands for at that length and beyond:
one running sum a conversation and one grouped sum, whatever the depth.

Numbers come from ranges of the order of pairs (``ranges``), so a first turn that all conversations share,
or one conversation with a third of all turns, is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import map_batches, spread_join, table, written
from lignum.llm.ranges import dense_names, running_sums

#: Ids that are joined to one text at a time, at most.
CHUNK = 1024


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, key, bytes``: turns from 0 in order of ``turn`` (null first), ties by a hash of role and text.

    ``key`` tells distinct turns (role, text) apart (SHA-256 of both); ``bytes`` is the text's length in UTF-8.
    Null roles and texts are empty. Rows without ``conv_id`` belong to no conversation and are left out;
    repeated rows are turns of their own. Other columns are ignored. Texts are read once and go no further.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256).alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).alias("one")
    )
    found = running_sums(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("key")], {"one": "pos"})
    return found.select("conv_id", (F.col("pos") - 1).alias("pos"), "key", "bytes")


def prefixes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, node`` of every prefix, the empty one included, and ``conv_id, pos, bytes`` of the turns.

    ``turns`` is as ``numbered_turns`` gives it, ``lengths`` has each ``conv_id`` with its number of turns ``n``.
    Nodes are numbered by depth, from 1 (the root).
    """
    named = dense_names(turns.select("conv_id", "pos", "key", "bytes"), ["key"])
    levels, most, size = [named.select("conv_id", F.col("pos").alias("i"), "name")], lengths.agg(F.max("n")).first()[0] or 0, 2
    while size <= most:
        even = F.col("i") % 2 == 0
        halves = levels[-1].groupBy("conv_id", F.floor(F.col("i") / 2).alias("at")).agg(F.max(F.when(even, F.col("name"))).alias("l"), F.max(F.when(~even, F.col("name"))).alias("r"))
        levels.append(dense_names(halves.filter("r IS NOT NULL"), ["l", "r"]).select("conv_id", F.col("at").alias("i"), "name"))
        size *= 2
    found = lengths.select("conv_id", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("name"))
    for k in reversed(range(len(levels))):
        blocks = levels[k].filter("i % 2 = 0").select("conv_id", F.floor(F.col("i") / 2).alias("m"), F.col("name").alias("r"))
        longer = found.join(blocks, ["conv_id", "m"]).select("conv_id", (F.col("m") * 2 + 1).alias("m"), F.col("name").alias("l"), "r")
        same = found.select("conv_id", (F.col("m") * 2).alias("m"), "name")
        if k:
            found = dense_names(longer, ["l", "r"]).select("conv_id", "m", "name").unionByName(same)
        else:
            found = longer.unionByName(same.select("conv_id", "m", F.col("name").alias("l"), F.lit(0).cast("long").alias("r")))
    nodes = dense_names(found.withColumnRenamed("m", "depth"), ["depth", "l", "r"], "node").select("conv_id", "depth", "node")
    return nodes, named.select("conv_id", "pos", "bytes")


def _hashes(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of ``node, conv_id``: ids are joined in blocks, whose texts are then hashed in a stream, one at a time."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = ends.groupBy("node", F.floor(F.col("conv_id") / CHUNK).alias("block")).agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        node, digest = None, None
        for b in batches:
            done = {"node": [], "ends_sha256": []}
            for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if n == node:
                    digest.update(b"," + ids.encode())
                else:
                    if digest:
                        done["node"].append(node)
                        done["ends_sha256"].append(digest.hexdigest())
                    node, digest = n, hashlib.sha256(ids.encode())
            yield done
        if digest:
            yield {"node": [node], "ends_sha256": [digest.hexdigest()]}

    return map_batches(chunks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids"), hashed, "node long, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (see ``numbered_turns``) of the conversations ``members`` (``conv_id``, once each).

    ``node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: the
    node's smallest member, that of its parent (root: null), how many conversations begin so, childless
    nodes in its subtree, bytes of last texts that are shared with another conversation, summed over it,
    and the SHA-256 of the ids of the members that end here. Conversations without turns are members of the
    root. No members give no rows; empty texts and roles are turns like others.
    """
    turns = turns.select("conv_id", "pos", "key", "bytes")
    lengths = members.select("conv_id").join(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left")
    lengths = written(lengths.select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "lengths")
    of, sizes = prefixes(turns, lengths)
    above = sizes.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes").join(of.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")), ["conv_id", "depth"])
    nodes = of.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"))
    nodes = written(nodes.join(above, ["conv_id", "depth"], "left"), "nodes")
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    weights = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved"))
    held = of.join(weights, ["conv_id", "depth"], "left").select("conv_id", "depth", "node", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved"))
    sums = running_sums(held, "conv_id", [F.col("depth").desc()], {"leaf": "leaves", "saved": "kept"}).groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("kept").alias("saved_tokens"))
    ends = _hashes(lengths.select("conv_id", F.col("n").alias("depth")).join(of, ["conv_id", "depth"]).select("node", "conv_id"))
    known = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("met"))
    named = spread_join(nodes.filter("parent IS NOT NULL"), known, "parent", "met").drop("met")
    named = named.unionByName(nodes.filter("parent IS NULL"), allowMissingColumns=True)
    out = named.join(sums, "node").join(ends, "node", "left")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings, and their ids: each takes its first h turns from the first of its ``group``.

    h is the crc32 of the id's decimal text, modulo ``most``; the conversation's own turns follow from its
    h-th on. The first of a group is the id rounded down to a multiple of ``group``; if it has no rows, nothing is taken.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(group))
    convs = convs.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), "n")
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there")), "base", "left")
    convs = written(convs.withColumn("head", F.least("h", F.coalesce("there", F.lit(0)))), "rebuilt")
    heads = turns.filter((F.pmod(F.col("conv_id"), F.lit(group)) == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "key", "bytes")
    taken = convs.select("conv_id", "base", "head").join(heads, "base").filter("pos < head").select("conv_id", "pos", "key", "bytes")
    own = spread_join(turns, convs.select("conv_id", "h", "head", "n"), "conv_id", "n").filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "key", "bytes")
    return written(taken.unionByName(own), "rebuilt-turns"), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that they share beginnings."""
    found = trie(*rebuilt(numbered_turns(table(spark, sf_dir, "conversations"))))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 byte by byte, by the table of remainders of its polynomial.
CRC_SQL = """bits AS (SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
remainders AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8)"""
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE_SQL = {
    "op11_prefix_trie": f"""WITH RECURSIVE {CRC_SQL},
turns AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos, key, bytes FROM (
  SELECT conv_id, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS key, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
ids AS MATERIALIZED (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, conv_id - ((conv_id % 5) + 5) % 5 AS base, count(*) AS n FROM turns GROUP BY 1),
crc AS (SELECT conv_id, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM ids UNION ALL
  SELECT conv_id, s, i + 1, xor(x.c >> 8, r.c) FROM crc x JOIN remainders r ON r.b = xor(x.c & 255, ascii(substr(s, i + 1, 1))) WHERE i < length(s)),
convs AS MATERIALIZED (SELECT a.conv_id, a.base, xor(c.c, 4294967295) % 9 AS h, coalesce(b.n, 0) AS there FROM ids a JOIN crc c ON c.conv_id = a.conv_id AND c.i = length(c.s) LEFT JOIN ids b ON b.conv_id = a.base),
made AS MATERIALIZED (SELECT c.conv_id, t.pos, key, bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, c.there), key, bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
pre AS MATERIALIZED (SELECT conv_id, pos + 1 AS depth, bytes, sha256(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS name FROM made UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS MATERIALIZED (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM pre GROUP BY 1, 2),
tied AS MATERIALIZED (SELECT n.*, p.name AS above FROM nodes n LEFT JOIN pre p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS MATERIALIZED (SELECT depth - 1 AS depth, above AS name, count(*) AS n_children FROM tied WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS MATERIALIZED (SELECT t.*, coalesce(n_children, 0) AS n_children FROM tied t LEFT JOIN kids USING (depth, name)),
below AS (SELECT p.depth, p.name, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * f.bytes) AS saved_tokens FROM full_nodes f JOIN pre p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1, 2),
ends AS (SELECT depth, name, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n FROM pre) WHERE depth = n GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes f JOIN below b ON b.depth = f.depth AND b.name = f.name LEFT JOIN ends e ON e.depth = f.depth AND e.name = f.name LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.name = f.above"""
}
