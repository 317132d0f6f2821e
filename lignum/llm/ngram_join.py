"""N-gram Jaccard self-join by grouped prefixes, up to connected components.

A document's set holds 64-bit hashes of its shingles. Two sets whose Jaccard similarity reaches the
threshold must share a shingle among the first ``n - ceil(t * n) + 1`` of each in any common order, so
only such prefixes are joined. The order puts rare shingles first: a sketch of fixed size counts
shingles by hash over all documents (counts only order shingles; they decide nothing), so common
passages come last and seldom enter a prefix.

Documents with the same prefix and size form one group, which joins as one. For each shingle the
groups holding it meet one of them first, the leader, which has the commonest prefix: a near copy
with changes of its own has rare shingles in front, so the leader tends to be the original. Pairs that
pass the filters (size, then a bound from parity bitmaps) are expanded to members and verified on
whole sets, and linked members become components. What remains is exact: in every shingle's list all
pairs of members of different components are compared, in tiles of a bounded number of members, and
verified likewise. A pair inside a component needs no test, so a large group of copies costs a row per
copy and not one per pair, and yet no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import map_batches, spread_join, table, written
from lignum.llm.components import components
from lignum.llm.words import chunks, mixed, word_hashes

#: The contract's shingle length and threshold, in hundredths. As near-duplicate stage these are 5 and 80.
N_WORDS, PERCENT = 4, 85
#: Counters of the sketch, at one byte each when it is broadcast: so many for each document, within these bounds.
COUNTERS_EACH, LEAST_COUNTERS, MOST_COUNTERS = 256, 1 << 16, 1 << 23
SLICES = 32
#: Groups in which tasks' counters are first summed, and documents for each task that sums them.
SALTS, SUMMED = 64, 20_000
#: Members of a shingle's list that meet in one tile, at most about twice this.
TILE = 256
#: Pairs of one document that are verified together.
PAIRS = 256
#: Bits of the filter that tells which documents to read again: so many for each, within these bounds.
FILTER_EACH, LEAST_FILTER, MOST_FILTER = 16, 1 << 18, 1 << 27
#: Hashes that a worker holds before it hands them on.
HELD = 1 << 17
_U = np.uint64


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ``data`` holds the texts' UTF-8 one after another."""
    word, at = word_hashes(data, ends)
    window = word[: max(0, len(word) - k + 1)].copy()
    for j in range(1, k):
        window = mixed(window * _U(0xD6E8FEB86659FD93) + word[j : j + len(window)])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(window[a : b - k + 1])
            continue
        h = np.full(min(1, b - a), b - a, dtype=np.uint64)
        for w in word[a:b]:
            h = mixed(h * _U(0xA0761D6478BD642F) + w)
        yield h


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of a batch, worked on in chunks of bounded size."""
    with np.errstate(over="ignore"):
        for low, _, data, ends in chunks(batch["text"]):
            for i, s in enumerate(shingle_sets(data, ends, k)):
                yield low + i, s


def _slot(s: np.ndarray, counters: int) -> np.ndarray:
    return (s & _U(counters - 1)).astype(np.int64)


def prefix_length(n, percent: int):
    """n - ceil(t * n) + 1."""
    return n - -(-percent * n // 100) + 1


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How common each counter's shingles are: about 16 times the binary logarithm of the count, in a byte.

    Several shingles share a counter once there are more than counters; common ones stand out all the same.
    """
    documents = docs.count()
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (documents * COUNTERS_EACH).bit_length()))
    width = counters // SLICES
    pack, unpack = (lambda x: zstandard.ZstdCompressor(level=1).compress(x)), (lambda x: zstandard.ZstdDecompressor().decompress(x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, salt = np.zeros(counters, dtype=np.uint32), None
        for batch in batches:
            for _, s in _sets(batch, k):
                np.add.at(total, _slot(s, counters), np.uint32(1))
                salt = int(s[0] & _U(SALTS - 1)) if salt is None and len(s) else salt
        for i in range(SLICES):
            yield {"slice": [i], "salt": [salt or 0], "counts": [pack(total[i * width : (i + 1) * width].tobytes())]}

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """One sum at a time, as the rows of a slice follow one another."""
        last, total = None, np.zeros(width, dtype=np.uint32)
        for batch in batches:
            for number, blob in zip(batch["slice"].to_pylist(), batch["counts"], strict=True):
                if last is not None and number != last:
                    yield {"slice": [last], "salt": [0], "counts": [pack(total.tobytes())]}
                    total[:] = 0
                last = number
                total += np.frombuffer(unpack(blob.as_buffer()), dtype=np.uint32)
        if last is not None:
            yield {"slice": [last], "salt": [0], "counts": [pack(total.tobytes())]}

    ddl = "slice int, salt int, counts binary"
    parts = map_batches(docs.select("text"), count, ddl)
    # Two levels of sums, so that no task adds up the sketches of all others; the first has more tasks for more documents.
    for tasks, keys in ((min(SLICES * SALTS, max(SLICES, documents // SUMMED)), ("slice", "salt")), (SLICES, ("slice",))):
        parts = map_batches(parts.repartition(tasks, *keys).sortWithinPartitions("slice"), added, ddl)
    out = np.zeros(counters, dtype=np.uint8)
    for r in parts.collect():  # SLICES rows, as many numbers as there are counters
        n = np.frombuffer(unpack(bytes(r.counts)), dtype=np.uint32)
        out[r.slice * width : (r.slice + 1) * width] = np.minimum(255, 16 * np.log2(1 + n.astype(np.float64)))
    return out


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the set's hashes over at least as many bits as it has members: differing bits bound the symmetric difference."""
    bits = 512
    while bits < len(s):
        bits *= 2
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """The bitmaps as rows of 64-bit words, longer ones folded to ``size`` bytes; parity survives folding."""
    rows = np.empty((len(bitmaps), size // 8), dtype=np.uint64)
    for i, b in enumerate(bitmaps):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(b, dtype=np.uint64).reshape(-1, size // 8), axis=0)
    return rows


def _may_link(n1, n2, differ, percent: int):
    """100 * i >= percent * u with u = (n1 + n2 + d) / 2, i = (n1 + n2 - d) / 2 for the least d possible."""
    d = np.maximum(differ, abs(n1 - n2))
    return 100 * (n1 + n2 - d) >= percent * (n1 + n2 + d)


def _entries(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document: size, hash of the set, group (hash of prefix and size), prefix, bitmap, and how common its prefix is."""
    common = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k))

    names = ("doc_id", "n", "whole", "prefix_key", "prefix", "bitmap", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        order = common.value

        def packed(rows: list) -> dict:
            columns = dict(zip(names, zip(*rows, strict=True), strict=True))
            cuts = np.cumsum([0, *map(len, columns["prefix"])])
            return columns | {"prefix": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(columns["prefix"]).view(np.int64)))}

        rows, held = [], 0
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for row, s in _sets(batch, k):
                n = len(s)
                rank = order[_slot(s, len(order))]
                p = prefix_length(n, percent) if n else 0
                prefix = s[np.lexsort((s, rank))[:p]]
                whole = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                key = hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest()
                rows.append((ids[row], n, whole, key, prefix, _bitmap(s) if n else b"", int(np.sort(rank)[:p].sum(dtype=np.int64))))
                held += n + 64
                if held >= HELD:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return written(
        map_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, whole binary, prefix_key binary, prefix array<long>, bitmap binary, weight long"),
        "ngram-entries",
    )


def _linked(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: ids) whose whole sets reach the threshold. A document may be ``b`` in any number of pairs.

    The pairs of one ``b`` are dealt to blocks; each block gets the set of ``b`` once, ahead of the others.
    """
    pairs = written(pairs.select("a", "b").distinct(), "ngram-pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ngram-wanted")
    wanted = ids.count()
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << (wanted * FILTER_EACH).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    # A bitmap of bounded size names the documents to read again; what it lets through in error is joined away.
    marks = ids.select(slot("id").alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("page"))
    filled = np.zeros(bits // 8, dtype=np.uint8)
    for r in marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        filled[(r.page - 1) * 4096 : r.page * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    filled = docs.sparkSession.sparkContext.broadcast(filled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows, held = [], 0
        for batch in batches:
            at = batch["slot"].to_numpy() - 1
            batch = batch.filter(pa.array((filled.value[at >> 3] >> (at & 7)) & 1).cast(pa.bool_()))
            ids = batch["doc_id"].to_pylist()
            for row, s in _sets(batch, k):
                rows.append((ids[row], s.tobytes()))
                held += len(s)
                if held >= HELD:
                    yield dict(zip(("id", "hashes"), zip(*rows, strict=True), strict=True))
                    rows, held = [], 0
        if rows:
            yield dict(zip(("id", "hashes"), zip(*rows, strict=True), strict=True))

    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", slot("doc_id").alias("slot"))
    if wanted * FILTER_EACH > MOST_FILTER:  # too many for the bitmap to spare reading; a join then does
        texts = texts.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    sets = written(map_batches(texts, read, "id long, hashes binary"), "ngram-sets")
    hubs = written(pairs.groupBy("b").agg(F.count("*").alias("size")), "ngram-hubs").withColumn("blocks", F.ceil(F.col("size") / PAIRS).cast("int"))
    others = spread_join(pairs, hubs, "b", "size").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks").cast("long")).cast("int").alias("block"))
    others = others.join(sets.select(F.col("id").alias("a"), "hashes"), "a")
    leads = hubs.join(sets.select(F.col("id").alias("b"), "hashes"), "b")
    leads = leads.select(F.lit(None).cast("long").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "hashes")
    both = others.select(*leads.columns).union(leads).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, lead = None, []
        for batch in batches:
            keep = []
            for a, *now, blob in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["block"].to_pylist(), batch["hashes"], strict=True):
                y = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                if a is None:  # rows that share an id may have several sets
                    lead = [*lead, y] if now == key else [y]
                    key = now
                    keep.append(False)
                    continue
                common = [int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0 for x in lead]
                keep.append(any(100 * c >= percent * (len(x) + len(y) - c) for c, x in zip(common, lead, strict=True)))
            yield {c: batch[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")}
            lead = [x.copy() for x in lead]

    return written(map_batches(both, verify, "a long, b long"), "ngram-links")


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that sizes and bitmaps allow."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x, y = batch["bits_a"].to_pylist(), batch["bits_b"].to_pylist()
            differ = np.zeros(batch.num_rows, dtype=np.int64)
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                size = min(len(p), len(q))
                differ[i] = np.bitwise_count(_folded([p], size) ^ _folded([q], size)).sum()
            keep = pa.array(_may_link(batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), differ, percent))
            yield {c: batch[c].filter(keep) for c in ("a", "b")}

    return map_batches(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), run, "a long, b long")


def _across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within each list that sizes and bitmaps allow.

    ``lists`` has ``token, size, cid, n, comp, bitmap``. A long list is cut into blocks by a hash of the
    id; each two blocks meet in one tile, so a tile stays small and none is the whole list.
    """
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks.cast("long")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rows = lists.select("token", "cid", "n", "comp", "bitmap", own.alias("own"), F.explode(tiles).alias("tile"))
    rows = rows.select("token", "tile.i", "tile.j", "own", "cid", "n", "comp", "bitmap")
    rows = rows.repartition(F.col("token"), F.col("i"), F.col("j")).sortWithinPartitions("token", "i", "j")

    def tile(part: list[tuple]) -> list[tuple[int, int]]:
        """Pairs of one tile; where two blocks meet, only those across them."""
        _, i, j, own, cid, n, comp, bitmap = zip(*part, strict=True)
        own, cid, n, comp = map(np.array, (own, cid, n, comp))
        size = min(map(len, bitmap))
        bits, out = _folded(bitmap, size), []
        for r in range(len(cid) - 1):
            rest = slice(r + 1, None)
            live = (comp[rest] != comp[r]) & (100 * np.minimum(n[rest], n[r]) >= percent * np.maximum(n[rest], n[r]))
            if i[0] != j[0]:
                live &= own[rest] != own[r]
            at = np.flatnonzero(live) + r + 1
            if len(at):
                differ = np.bitwise_count(bits[at] ^ bits[r]).sum(axis=1, dtype=np.int64)
                at = at[_may_link(n[at], n[r], differ, percent)]
                out += [(int(max(cid[r], c)), int(min(cid[r], c))) for c in cid[at]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part: list[tuple] = []
        names = ("token", "i", "j", "own", "cid", "n", "comp", "bitmap")
        for batch in batches:
            found = []
            for row in zip(*[batch[c].to_pylist() for c in names], strict=True):
                if part and row[:3] != part[0][:3]:
                    found += tile(part)
                    part = []
                part.append(row)
            yield {"a": [x[0] for x in found], "b": [x[1] for x in found]}
        if part:
            found = tile(part)
            yield {"a": [x[0] for x in found], "b": [x[1] for x in found]}

    return map_batches(rows, run, "a long, b long").distinct()


def join(docs: DataFrame, k: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Words part at ASCII white space, A-Z
    count as a-z. A document's set holds its distinct shingles of ``k`` words; a shorter text is one
    shingle. Documents link when 100 * intersection >= ``percent`` * union, and ``component_id`` is the
    smallest doc_id reachable by links, its own included.

    Null, empty or blank text has no shingles, links with nothing and is its own component. A row
    without an id has a null component and lends no id to others. Repeated rows each give a row, and
    rows that share an id count as one document. An empty table gives no rows. Shingles are told apart
    by 64-bit hashes.
    """
    entries = _entries(docs, k, percent)
    named = entries.filter("n > 0 AND doc_id IS NOT NULL")
    # A class: equal sets. Its id is its smallest doc_id; copies meet as counts and minima only.
    classes = named.groupBy("prefix_key", "whole").agg(F.min("doc_id").alias("cid"))
    reps = named.join(classes.select("cid", F.col("whole").alias("of")), (F.col("doc_id") == F.col("cid")) & (F.col("whole") == F.col("of")))
    reps = written(reps.select("cid", "n", "prefix_key", "prefix", "bitmap", "weight").dropDuplicates(["cid"]), "ngram-classes")
    # A group: equal prefix and size; its first class stands for it in the join.
    groups = reps.groupBy("prefix_key").agg(F.min("cid").alias("gid"))
    members = reps.join(groups, "prefix_key")
    posts = members.filter("cid = gid").select(F.explode("prefix").alias("token"), "gid", "weight")
    best = F.struct("weight", (-F.col("gid")).alias("id"))
    lists = posts.groupBy("token").agg(F.count("*").alias("size"), F.max(best).alias("lead")).filter("size > 1")
    lists = written(lists.select("token", "size", (-F.col("lead.id")).alias("leader")), "ngram-leaders")
    # A group of several classes has pairs of its own, whether or not another group shares its shingles.
    many = members.groupBy("gid").agg(F.count("*").alias("classes")).filter("classes > 1").select("gid")
    met = written(spread_join(posts.select("token", "gid"), lists, "token", "size").select("token", "gid", "size", "leader"), "ngram-lists")

    classes_of = members.select("gid", "cid")
    pairs = met.select("gid", "leader").filter("gid <> leader").union(many.select("gid", F.col("gid").alias("leader"))).distinct()
    pairs = pairs.join(classes_of, "gid").filter("cid <> leader").select(F.col("cid").alias("a"), F.col("leader").alias("b")).distinct()
    links = _linked(docs, _close(pairs, reps, percent), k, percent)
    parts = written(components(links), "ngram-components")

    # What remains: lists that still hold several components, and groups likewise.
    state = reps.select("cid", "n", "bitmap").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    state = state.withColumn("comp", F.coalesce("component", "cid")).drop("component")
    in_lists = met.select("token", "gid").join(classes_of, "gid").select("token", "cid")
    in_groups = many.join(classes_of, "gid").select((-F.abs(F.xxhash64("gid")) - 1).alias("token"), "cid")
    rows = in_lists.union(in_groups)
    open_lists = rows.join(state.select("cid", "comp"), "cid").groupBy("token").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_lists = written(open_lists.filter("lo < hi").select("token", "size"), "ngram-open")
    rows = spread_join(rows, open_lists, "token", "size").join(state, "cid")
    more = written(_across(rows, percent), "ngram-more")
    known = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = links.union(_linked(docs, more.join(known, ["a", "b"], "left_anti"), k, percent))
    parts = components(links).withColumnRenamed("node", "cid")

    final = classes.join(parts, "cid", "left").select(F.col("whole").alias("of"), F.coalesce("component", "cid").alias("component"))
    out = entries.join(final, (F.col("whole") == F.col("of")) & (F.col("n") > 0), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the contract's four words and 85 in 100."""
    return join(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_join": op7_ngram_join}
#: Every pair that shares a shingle is counted, so this is for small tables.
ORACLE_SQL = {
    "op7_ngram_join": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*)))
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM sets s JOIN
  (WITH RECURSIVE reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b) SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id"""
}
