"""Approximate nearest neighbours by cross-polytope hashing.

For the largest inner product, rows are parted by number of components and into bands of like length,
and a vector is extended by one component that brings all of its band to the length of the band's
longest, so that the nearest in angle is the largest in product. Each of several tables rotates the
extended vectors by fast Hadamard pseudo-rotations and files every row under its nearest signed axis.
Where a part has many rows, further rotations are concatenated, the last on fewer axes, so that a cell
holds some hundred rows at any size; where it has few, the one rotation keeps fewer axes. A query probes, in each table and part, the cells whose axes its
own rotations lean to most. Rows it meets are ranked by the exact product of the original vectors, and
the best of all cells are merged.

The join is on (part, table, cell). Cells with many rows are cut into blocks by a hash of the id, each
of which the queries meet, so no task holds a hot cell whole. A query that met fewer rows than it is to
return is compared with all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import map_batches, table, written
from lignum.llm.vectors import groups, matrix, padded, power_of_two, rotated, signs, usable

TOP, QUERY_STEP = 20, 20
TABLES = 10
#: Rows of a cell for which another hash is concatenated, and above which a cell is cut into blocks.
CELL_ROWS, BLOCK = 256, 4096
#: Rows of a cell, about, where a part has too few for all axes.
FEW_ROWS = 16
#: Of C cells of a table a query probes PROBE_SHARE * C ** PROBE_POWER and one more; the recall of this is in the README.
PROBE_SHARE, PROBE_POWER = 0.163, 0.775
#: Queries that meet a block of rows at once where all are compared.
ASKED = 1024
#: Bands of length for each factor of 2.
BANDS = 2
#: Products held at a time, and exact ones computed at a time.
HELD, EXACT = 1 << 21, 1 << 15
SEED = 6
BEST = "query_id long, ids array<long>, scores array<double>"


def polytopes(rows: int, width: int) -> list[int]:
    """The numbers of axes (without sign) of the hashes that make up a cell's number."""
    first = min(width, max(1, 1 << max(0, (rows // (2 * FEW_ROWS)).bit_length() - 1)))
    found, cells = [first], 2 * first
    while (more := rows // (2 * CELL_ROWS * cells)) >= 1:
        found.append(min(width, 1 << (more.bit_length() - 1)))
        cells *= 2 * found[-1]
    return found


def probe_count(widths: list[int]) -> int:
    cells = math.prod(2 * w for w in widths)
    return min(cells, math.ceil(PROBE_SHARE * cells**PROBE_POWER) + 1)


def extended(x: np.ndarray, longest: float, width: int) -> np.ndarray:
    """Rows over the ``longest`` of their band, with the component that makes them unit vectors."""
    x = x / longest
    rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
    return padded(np.concatenate([x, rest[:, None]], axis=1), width)


def leanings(x: np.ndarray, flips: np.ndarray, widths: list[int]) -> Iterator[list[np.ndarray]]:
    """For each table, how far each row leans to each signed axis of each hash."""
    for t in range(0, len(flips), len(widths)):
        found = [rotated(x, flips[t + j])[:, :w] for j, w in enumerate(widths)]
        yield [np.concatenate([y, -y], axis=1) for y in found]


def cells(x: np.ndarray, flips: np.ndarray, widths: list[int]) -> np.ndarray:
    """The cell of each row in each table."""
    strides = np.cumprod([1, *(2 * w for w in widths[:-1])])
    return np.stack([sum(y.argmax(axis=1) * s for y, s in zip(sides, strides, strict=True)) for sides in leanings(x, flips, widths)], axis=1)


def probed(x: np.ndarray, flips: np.ndarray, widths: list[int], probes: int) -> np.ndarray:
    """The cells that each row leans to most, table after table; few of many hashes are ever combined at once."""

    def best(score: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(score, at, 1), np.take_along_axis(code, at, 1)

    out, step = [], max(1, HELD // (probes * 2 * max(widths)))
    for low in range(0, len(x), step):
        found = []
        for first, *others in leanings(x[low : low + step], flips, widths):
            score, code = best(first, np.broadcast_to(np.arange(first.shape[1]), first.shape))
            stride = first.shape[1]
            for y in others:
                n = y.shape[1]
                score, code = best((score[:, :, None] + y[:, None, :]).reshape(len(y), -1), (code[:, :, None] + stride * np.arange(n)).reshape(len(y), -1))
                stride *= n
            found.append(code)
        out.append(np.concatenate(found, axis=1))
    return np.concatenate(out)


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list column from all values and the number in each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def nearest(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, y: np.ndarray, top: int) -> Iterator[dict]:
    """The ``top`` rows with the largest product for each query, its own id aside, nearest first, ties to the smaller id.

    A matrix product finds all that may be among them; their scores are then summed in one order, so
    equal vectors tie exactly.
    """
    slack = 1e-9 * np.sqrt((x * x).sum(axis=1).max())
    step = max(1, HELD // len(ids))
    for low in range(0, len(queries), step):
        own, part = queries[low : low + step], y[low : low + step]
        product = part @ x.T
        product[own[:, None] == ids[None, :]] = -np.inf
        least = np.full(len(own), -np.inf)
        if len(ids) > top:
            least = np.partition(product, len(ids) - top, axis=1)[:, len(ids) - top] - slack * np.sqrt((part * part).sum(axis=1))
        q, r = np.nonzero((product >= least[:, None]) & (product > -np.inf))
        if not len(q):
            continue
        score = np.concatenate([np.einsum("ij,ij->i", part[q[i : i + EXACT]], x[r[i : i + EXACT]], optimize=False) for i in range(0, len(q), EXACT)])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1])
        live = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < top
        who, sizes = np.unique(q[live], return_counts=True)
        yield {"query_id": own[who], "ids": listed(ids[r[live]], sizes), "scores": listed(score[live], sizes)}


def met(both: DataFrame, keys: list[str], top: int) -> DataFrame:
    """What the queries (``asks`` = 1) of each group of ``keys`` find among its rows (``asks`` = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in groups(batches, keys):
            group = group.combine_chunks()
            asks = group["asks"].to_numpy() == 1
            if not asks.all() and asks.any():
                ids, x = group["vec_id"].to_numpy(), matrix(group["embedding"].combine_chunks())
                yield from nearest(ids[~asks], x[~asks], ids[asks], x[asks], top)

    return map_batches(both.repartition(*keys).sortWithinPartitions(*keys, "asks").select(*keys, "vec_id", "embedding", "asks"), run, BEST)


def compared(rows: DataFrame, asked: DataFrame, top: int, block: int) -> DataFrame:
    """The best rows of each block for each query, as ``BEST`` has them: all rows of as many components are compared, in blocks that meet groups of queries."""
    blocks, parts = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // ASKED))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = ["vec_id", "embedding", F.size("embedding").alias("d")]
    filed = rows.select(*own, dealt(blocks).alias("b"), every(parts).alias("q"), F.lit(0).alias("asks"))
    asking = asked.select(*own, every(blocks).alias("b"), dealt(parts).alias("q"), F.lit(1).alias("asks"))
    return met(filed.unionByName(asking), ["d", "b", "q"], top)


def merged(found: DataFrame, top: int) -> DataFrame:
    """The best of all groups that a query met; what it met in several tables counts once."""

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])])
        return ids[fresh][:top], scores[fresh][:top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, held = None, (np.zeros(0, np.int64), np.zeros(0))
        done: list[tuple] = []
        for batch in batches:
            sizes = np.array(batch["ids"].value_lengths())
            if not len(sizes):
                continue
            query, ids, scores = batch["query_id"].to_numpy(), batch["ids"].flatten().to_numpy(), batch["scores"].flatten().to_numpy()
            ends = np.cumsum(sizes)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1, [len(query)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = slice(ends[a] - sizes[a], ends[b - 1])
                if last is not None and query[a] != last:
                    done.append((last, *held))
                    held = (np.zeros(0, np.int64), np.zeros(0))
                last = int(query[a])
                held = best(np.concatenate([held[0], ids[part]]), np.concatenate([held[1], scores[part]]))
            if len(done) >= 1000:
                yield packed(done)
                done = []
        if last is not None:
            yield packed([*done, (last, *held)])

    def packed(done: list[tuple]) -> dict:
        query, ids, scores = zip(*done, strict=True)
        sizes = np.array([len(i) for i in ids])
        return {"query_id": list(query), "ids": listed(np.concatenate(ids), sizes), "scores": listed(np.concatenate(scores), sizes)}

    return map_batches(found.repartition("query_id").sortWithinPartitions("query_id"), run, BEST)


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, tables: int = TABLES, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the rows found with the largest inner product.

    Both frames have ``vec_id`` and ``embedding``; other columns are ignored. Nearest first, ties to the
    smaller vec_id: ``top`` rows, or all candidates if there are fewer. A query's candidates are all rows of
    another vec_id with as many components as it has. Null or zero vectors, those with null or non-finite
    components and rows without an id take no part. Rows that repeat an id and vector are one candidate and
    one query. Scores are products in double precision, summed in one order, so equal vectors tie exactly.
    An empty table gives no rows. ``probes`` is the number of cells in each table, taken from how many there
    are if not given.
    """
    good = lambda df: df.select("vec_id", "embedding").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "embedding"])
    rows, asked = good(vectors), written(good(queries), "ann-queries")
    d = F.size("embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = written(rows.withColumn("d", d).withColumn("norm", norm), "ann-rows")
    # Bands reach down from the longest, so lengths that are equal but for rounding share one. Floats reach a few hundred bands far.
    longest = {r.d: r.longest for r in rows.groupBy("d").agg(F.max("norm").alias("longest")).collect()}
    if not longest:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    reach = F.create_map(*[F.lit(x) for pair in longest.items() for x in pair])
    rows = rows.withColumn("band", F.floor(F.log2(reach[F.col("d")] / F.col("norm")) * BANDS).cast("int"))
    parts = {}
    for r in rows.groupBy("d", "band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect():
        width = power_of_two(r.d + 1)
        widths = polytopes(r.n, width)
        parts[r.d, r.band] = {"part": len(parts), "longest": r.longest, "width": width, "widths": widths}

    def split(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        of = np.stack([batch[c].to_numpy() for c in by], axis=1)
        for key in np.unique(of, axis=0) if len(of) else []:
            yield tuple(key.tolist()), batch.filter(pa.array((of == key).all(axis=1)))

    def flips(p: dict) -> np.ndarray:
        return signs(tables * len(p["widths"]), p["width"], SEED)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for key, own in split(batch, ["d", "band"]):
                p, x = parts[key], matrix(own["embedding"])
                codes = cells(extended(x, p["longest"], p["width"]), flips(p), p["widths"]).astype(np.int64)
                yield {"vec_id": own["vec_id"], "embedding": own["embedding"], "part": [p["part"]] * len(x), "codes": listed(codes.ravel(), np.full(len(x), codes.shape[1]))}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for (size,), own in split(batch, ["d"]):
                x = matrix(own["embedding"])
                for p in [p for (d, _), p in parts.items() if d == size]:
                    each = min(probes or probe_count(p["widths"]), math.prod(2 * w for w in p["widths"]))
                    codes = probed(padded(x / np.sqrt((x * x).sum(axis=1))[:, None], p["width"]), flips(p), p["widths"], each).astype(np.int64)
                    yield {"vec_id": own["vec_id"], "embedding": own["embedding"], "part": [p["part"]] * len(x), "codes": listed(codes.ravel(), np.full(len(x), codes.shape[1]))}

    kind = dict(rows.dtypes)["embedding"]
    ddl = f"vec_id long, embedding {kind}, part int, codes array<long>"
    filed = written(map_batches(rows.select("vec_id", "embedding", "d", "band"), index, ddl), "ann-index")
    probing = map_batches(asked.select("vec_id", "embedding", d.alias("d")), ask, ddl)
    keys = ["part", "t", "code"]
    each = filed.select("vec_id", "embedding", "part", F.posexplode("codes").alias("t", "code"))
    # Cells above the block size: as many as rows * tables / block at most, mostly none. Spark broadcasts them if that is little.
    hot = written(each.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > block).select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "ann-hot")
    one = F.coalesce("blocks", F.lit(1))
    salted = each.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), one.cast("long")).cast("int"))
    probing = probing.select("vec_id", "embedding", "part", F.size("codes").alias("all"), F.posexplode("codes").alias("at", "code"))
    probing = probing.withColumn("t", F.floor(F.col("at") * tables / F.col("all")).cast("int")).join(hot, keys, "left")
    probing = probing.withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1)))
    columns = [*keys, "salt", "vec_id", "embedding"]
    both = salted.select(*columns, F.lit(0).alias("asks")).union(probing.select(*columns, F.lit(1).alias("asks")))
    # Those that met too few rows are asked again, and what they find then counts instead.
    best = written(merged(met(both, [*keys, "salt"], top), top), "ann-found")
    full = best.filter(F.size("ids") >= top)
    short = written(asked.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "ann-short")
    if not short.isEmpty():
        best = full.union(merged(compared(filed, short, top, block), top))
    out = best.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose vec_id is divisible by 20, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


QUERIES = {"op6_ann": op6_ann}
ORACLE_SQL: dict[str, str] = {}
