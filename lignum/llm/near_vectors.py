"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

Each unit vector is rotated at random and quantised twice: to the signs of its components, and to four
bits a component by randomised rounding. The inner product of one row's signs with another's four bits
takes only ANDs and bit counts, and divided by the correction factor (the product of the signs with
the vector itself) it estimates the cosine without bias; the factor also tells how far off the estimate
can be. Codes and factors are computed once and stored. Pairs whose upper bound stays below the
threshold are dropped on them alone; all others are recomputed exactly in double precision, so no pair
below the threshold ever links.

Which pairs meet: rows of one label that share the nearest signed axes of one of several rotations. How
many axes, and so how many buckets, goes by the label's rows, so that a bucket holds some hundred rows
at any size; how many rotations goes by the chance that a pair at the threshold shares a bucket.
Equal vectors are folded into one with a count first. A bucket is cut into blocks by a hash of the id
and each two blocks meet in a tile, so no task holds a bucket whole. A tile returns link counts and a
spanning forest instead of its pairs, so a bucket of near copies gives rows in proportion to itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import map_batches, spread_join, table, written
from lignum.llm.components import components
from lignum.llm.vectors import axis_codes, groups, matrix, padded, power_of_two, rotated, signs, usable

COSINE = 0.98
#: Rows of a bucket on average, and the chance that a pair at the threshold shares none of the buckets.
BUCKET, MISS = 256, 3e-6
#: Width of the code, in bits for each component, bits of the finer one, and the confidence of bounds in standard errors.
WIDEN, FINE, ERRORS = 2, 4, 5.0
TILE = 512
#: Pairs estimated at a time, and exactly compared at a time.
PAIRS, EXACT = 1 << 17, 1 << 15
SEED = 5


def polytopes(rows: int, width: int) -> tuple[int, ...]:
    """The numbers of axes of the hashes that make up a bucket's number; none for few rows."""
    found, buckets = [], 1
    while (more := rows // (2 * BUCKET * buckets)) >= 1:
        found.append(min(width, 1 << (more.bit_length() - 1)))
        buckets *= 2 * found[-1]
    return tuple(found)


@cache
def shared(axes: int, cosine: float) -> float:
    """The chance that two vectors at the cosine have the same nearest of so many signed axes under a random rotation."""
    draw = np.random.default_rng(axes)
    a, b = draw.normal(size=(2, 4000, axes))
    return float((axis_codes(a) == axis_codes(cosine * a + math.sqrt(1 - cosine**2) * b)).mean())


def rotations(widths: tuple[int, ...], cosine: float) -> int:
    if not widths:
        return 1
    chance = min(1 - 1e-9, math.prod(shared(w, cosine) for w in widths))
    return math.ceil(math.log(MISS) / math.log(1 - chance))


def buckets_of(x: np.ndarray, widths: tuple[int, ...], cosine: float) -> np.ndarray:
    """The bucket of each row (of a power of two components) under each rotation."""
    tables, out = rotations(widths, cosine), []
    flips = signs(tables * max(1, len(widths)), x.shape[1], SEED)
    for t in range(tables):
        code = np.zeros(len(x), dtype=np.int64)
        for j, w in enumerate(widths):
            code = code * 2 * w + axis_codes(rotated(x, flips[t * len(widths) + j])[:, :w])
        out.append(code)
    return np.stack(out, axis=1)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit numbers."""
    packed = np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little")
    return padded(packed.reshape(-1, packed.shape[-1]), -(-packed.shape[-1] // 8) * 8).view(np.uint64).reshape(*bits.shape[:-1], -1)


def code_of(unit: np.ndarray, flips: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """What is stored of unit vectors: signs, their correction factors <signs, vector>, and the finer code with its scale."""
    x = rotated(padded(unit, flips.shape[-1]), flips)
    width = x.shape[1]
    low = x.min(axis=1)
    step = np.maximum((x.max(axis=1) - low) / ((1 << FINE) - 1), 1e-12)
    # Rounded up or down at random, so that the code is right on average.
    fine = np.floor((x - low[:, None]) / step[:, None] + np.random.default_rng([seed, width]).random(width)).clip(0, (1 << FINE) - 1).astype(np.int64)
    return {
        "signs": words(x >= 0),
        "factor": np.abs(x).sum(axis=1) / math.sqrt(width),
        "planes": np.stack([words(fine >> j & 1) for j in range(FINE)], axis=1),
        "low": low,
        "step": step,
        "total": fine.sum(axis=1).astype(np.float64),
    }


def estimates(a: dict, b: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of <a, b> from the signs of ``a`` and the finer codes of ``b``, and their error bounds."""
    both = np.zeros((len(a["signs"]), len(b["signs"])))
    for j in range(FINE):
        for w in range(a["signs"].shape[1]):
            both += np.bitwise_count(a["signs"][:, None, w] & b["planes"][None, :, j, w]) * float(1 << j)
    ones = 2.0 * np.bitwise_count(a["signs"]).sum(axis=1, dtype=np.int64) - width
    product = ones[:, None] * b["low"][None] + b["step"][None] * (2 * both - b["total"][None])
    f = a["factor"][:, None]
    # The signs' own error, and that of rounding, whose variance is a quarter of a squared step at most.
    error = ERRORS * np.sqrt(np.maximum(0, 1 - f**2) / (width - 1) + b["step"][None] ** 2 / 4) / f
    return product / math.sqrt(width) / f, error


def links_between(x: np.ndarray, code: dict, width: int, cosine: float, allowed) -> np.ndarray:
    """Which rows reach the cosine with which, of the pairs for which ``allowed`` (of two arrays of rows) holds."""
    n = len(x)
    norm = np.sqrt((x * x).sum(axis=1))
    out = np.zeros((n, n), dtype=bool)
    step = max(1, PAIRS // n)
    for low in range(0, n, step):
        part = {k: v[low : low + step] for k, v in code.items()}
        rest = {k: v[low:] for k, v in code.items()}
        estimate, error = estimates(part, rest, width)
        open_ = estimate + error >= cosine
        estimate, error = estimates(rest, part, width)
        i, j = np.nonzero(open_ & (estimate + error >= cosine).T)
        i, j = i + low, j + low
        live = i < j
        live[live] = allowed(i[live], j[live])
        i, j = i[live], j[live]
        for k in range(0, len(i), EXACT):  # exactly, for those the bounds leave open
            p, q = i[k : k + EXACT], j[k : k + EXACT]
            out[p, q] = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine
    return out | out.T


def forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a small symmetric graph the first node of its component."""
    n = len(linked)
    label = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored. Rows link when their labels
    are equal and not null and the cosine found is at least ``cosine``. Null or zero vectors, those
    with null or non-finite components and rows without an id link with nothing, nor do vectors of
    different lengths. ``component_id`` is the smallest vec_id reachable, ``kept`` whether it is the
    row's own. A row without an id has a null component and isn't kept. Repeated rows each give a row
    and count as links of one another. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    kinds = dict(rows.dtypes)
    good = rows.filter(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")), "vector-classes")
    # The binary logarithm of a label's rows fixes its buckets.
    of_label = written(classes.groupBy("label").agg(F.count("*").alias("rows")), "vector-labels")
    ready = spread_join(classes, of_label, "label", "rows").withColumn("level", F.floor(F.log2("rows")).cast("int"))
    stored = ("signs", "planes")
    numbers = ("factor", "low", "step", "total")

    def flips(d: int) -> np.ndarray:
        return signs(1, WIDEN * power_of_two(d), SEED + 1)[0]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            of = np.stack([np.array(batch["embedding"].value_lengths(), dtype=np.int64), batch["level"].to_numpy().astype(np.int64)], axis=1)
            for d, level in np.unique(of, axis=0).tolist() if len(of) else []:
                own = batch.filter(pa.array((of == (d, level)).all(axis=1)))
                x = matrix(own["embedding"])
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                code = code_of(unit, flips(d))
                at = buckets_of(padded(unit, power_of_two(d)), polytopes(1 << level, power_of_two(d)), cosine)
                yield {c: own[c] for c in ("cid", "copies", "label", "embedding")} | {"codes": at.tolist()} | {c: [r.tobytes() for r in code[c]] for c in stored} | {c: code[c] for c in numbers}

    ddl = f"cid {kinds['vec_id']}, copies long, label {kinds['label']}, embedding {kinds['embedding']}, codes array<long>, signs binary, planes binary, factor double, low double, step double, total double"
    coded = written(map_batches(ready, encode, ddl), "vector-codes")
    each = coded.select("*", F.size("embedding").alias("d"), F.posexplode("codes").alias("t", "code"))
    keys = ["label", "d", "t", "code"]
    # Buckets above the tile's size, mostly none; Spark broadcasts them if they are few.
    hot = written(each.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > tile).select(*keys, F.ceil(F.col("n") / tile).cast("int").alias("blocks")), "vector-hot")
    each = each.join(hot, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("cid", F.lit(SEED)), F.col("blocks").cast("long")).cast("int")
    each = each.withColumn("own", own)
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    each = each.withColumn("tile", F.explode(tiles)).select(*keys, "tile.i", "tile.j", "own", "cid", "copies", "embedding", "codes", *stored, *numbers)
    dealt = each.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in groups(batches, [*keys, "i", "j"]):
            if group.num_rows == 1:
                continue
            group = group.combine_chunks()
            x, own, cid, copies = matrix(group["embedding"].combine_chunks()), *(group[c].to_numpy() for c in ("own", "cid", "copies"))
            codes = np.array(group["codes"].combine_chunks().flatten()).reshape(len(cid), -1)
            width = WIDEN * power_of_two(x.shape[1])
            code = {c: np.frombuffer(b"".join(group[c].to_pylist()), dtype=np.uint64).reshape(len(cid), -1) for c in stored} | {c: group[c].to_numpy() for c in numbers}
            code["planes"] = code["planes"].reshape(len(cid), FINE, -1)
            t, i, j = (group[c][0].as_py() for c in ("t", "i", "j"))

            def allowed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                """A pair counts in the first rotation where its buckets agree; where two blocks meet, only pairs across them."""
                across = own[p] != own[q] if i != j else np.ones(len(p), dtype=bool)  # noqa: B023
                for earlier in range(t):  # noqa: B023
                    across &= codes[p, earlier] != codes[q, earlier]  # noqa: B023
                return across

            linked = links_between(x, code, width, cosine, allowed)
            near = linked.any(axis=1)
            if near.any():
                root = forest(linked)
                yield {"cid": cid[near], "links": (linked @ copies)[near], "root": cid[root][near]}

    met = written(map_batches(dealt, meet, "cid long, links long, root long"), "vector-links")
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(met.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    final = classes.join(links, "cid", "left").join(parts, "cid", "left")
    final = final.select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")
    )
    out = rows.join(final, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, with production parameters."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_near_vectors": op5_near_vectors}
#: The components of a vector are summed one after another in double precision, as the exact comparison does but for the last bits.
ORACLE_SQL = {
    "op5_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, root.component_id, coalesce(e.vec_id = root.component_id, false) AS kept
FROM embeddings e LEFT JOIN root ON root.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
}
