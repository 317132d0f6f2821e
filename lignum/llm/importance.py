"""Resampling documents towards a target distribution by importance weights over hashed n-grams.

The counts of each document's hashed features are a sparse matrix, documents by buckets. It is made once,
stored as blocks in compressed sparse rows (ids, row bounds, columns, counts: one Parquet row a block), and
all that follows reads these blocks and no text: sums over columns are the distributions of the corpus and
of the target, and the product with the vector of gains is each document's weight. Documents are then drawn
without replacement by the largest weight plus Gumbel noise from a hash of the id.

A block has so many entries at most; a document is never split, and has no more entries than there are
buckets. What the driver and each task hold is one number a bucket.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import map_batches, table, written
from lignum.llm.prefix_trie import CRC_SQL
from lignum.llm.ranges import running_sums

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
SCALE = 1000
#: Entries of a block, about; a block of documents without any has so many documents at most.
ENTRIES, ROWS = 1 << 17, 1 << 14
#: Texts are worked on in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
#: What words are made of, in UTF-8, once A-Z are lower case: 0-9, a-z and everything beyond ASCII.
_WORD, _BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
BLOCK = "doc_ids array<long>, n_words array<long>, bounds array<int>, buckets array<int>, counts array<int>"


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(data):
        stop = _BREAK.search(data, min(at + PIECE, len(data)))
        end = stop.start() if stop else len(data)
        yield _WORD.findall(data, at, end)
        at = end + 1 if stop else end


def features(text: str | None, longest: int = 1, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of a text, and how many of its runs of 1 to ``longest`` words are in each bucket."""
    counts, n, before = np.zeros(buckets, dtype=np.int64), 0, []
    for words in _pieces((text or "").encode().lower()):  # bytes: A-Z only
        n += len(words)
        joined = before + words
        for length in range(1, longest + 1):
            first = max(0, len(before) - length + 1)
            runs = joined[first:] if length == 1 else [b" ".join(joined[i : i + length]) for i in range(first, len(joined) - length + 1)]
            if runs:
                hashed = np.fromiter(map(zlib.crc32, runs), dtype=np.uint32, count=len(runs))
                counts += np.bincount(hashed % np.uint32(buckets), minlength=buckets)
        before = joined[len(joined) - longest + 1 :] if longest > 1 else []
    return n, counts


def csr_blocks(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The count matrix of ``doc_id, text`` as stored blocks: each has its documents' ids and numbers of words, and compressed sparse rows.

    Null and empty texts are rows without entries; null ids and repeated rows are rows like others; whole
    texts count, in pieces. Other columns are ignored; an empty table gives no blocks.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, sizes, bounds, columns, values, held = [], [], [0], [], [], 0
        for b in batches:
            for i, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                n, counts = features(text.as_py(), longest, buckets)
                some = np.flatnonzero(counts)
                ids.append(i.as_py())
                sizes.append(n)
                columns.append(some.astype(np.int32))
                values.append(counts[some].astype(np.int32))
                held += len(some)
                bounds.append(held)
                if held >= ENTRIES or len(ids) >= ROWS:
                    yield {"doc_ids": [ids], "n_words": [sizes], "bounds": [bounds], "buckets": [np.concatenate(columns)], "counts": [np.concatenate(values)]}
                    ids, sizes, bounds, columns, values, held = [], [], [0], [], [], 0
        if ids:
            yield {"doc_ids": [ids], "n_words": [sizes], "bounds": [bounds], "buckets": [np.concatenate(columns)], "counts": [np.concatenate(values)]}

    return written(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), made, BLOCK), "csr")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents are in each bucket: a vector a task, added up by bucket."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            columns, values = b.column("buckets").flatten().to_numpy(), b.column("counts").flatten().to_numpy()
            np.add.at(total, columns, values)
        some = np.flatnonzero(total)
        yield {"bucket": some.astype(np.int32), "n": total[some]}

    out = np.zeros(buckets, dtype=np.int64)
    for r in map_batches(blocks.select("buckets", "counts"), summed, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """A bucket's gain: the log of how much likelier it is in the target, each count one higher, in thousandths, rounded down."""
    k, t_all, s_all = len(target), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(SCALE * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], dtype=np.int64)


def weigh(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the matrix times the gains, and the sums of its rows."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for j in range(b.num_rows):
                bounds, columns, values = (b.column(c)[j].values.to_numpy() for c in ("bounds", "buckets", "counts"))
                values = values.astype(np.int64)
                total = np.concatenate([[0], np.cumsum(values * gains[columns])])[bounds]
                n = np.concatenate([[0], np.cumsum(values)])[bounds]
                yield {"doc_id": b.column("doc_ids")[j].values, "n_words": b.column("n_words")[j].values, "n_features": np.diff(n), "weight": np.diff(total)}

    return map_batches(blocks, weighed, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: every document, and its place in the draw, or null.

    ``docs`` has ``doc_id, text``, ``target`` has ``text``. Of the documents with at least ``least_words``
    words, ``percent`` of 100 (rounded down) with the highest scores are drawn; ties go to the smaller id, null
    last, then by the other columns. A score is the weight plus noise from the id alone; a null id counts as an
    empty text there. Documents without words weigh nothing and have a score; an empty target leaves the
    corpus's own rarity as gains; no documents give no rows.
    """
    blocks = csr_blocks(docs, longest, buckets)
    corpus = column_sums(blocks, buckets)
    wanted = column_sums(csr_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weigh(blocks, bucket_gains(wanted, corpus)).withColumn("score", F.col("weight") + noise), "scores")
    n = scored.filter(F.col("n_words") >= least_words).count()
    entered = scored.filter(F.col("n_words") >= least_words).withColumns({"one": F.lit(1), "all": F.lit(0).cast("long")})
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("n_words")]
    placed = running_sums(entered, "all", order, {"one": "rank"}).drop("one", "all")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return placed.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's texts."""
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op12_importance": op12_importance}
ORACLE_SQL = {
    "op12_importance": f"""WITH RECURSIVE {CRC_SQL},
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
words AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM docs) GROUP BY 1, 2),
aims AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) GROUP BY 1),
crc AS (SELECT w, hex(encode(w)) AS x, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT w FROM words UNION SELECT w FROM aims) UNION ALL
  SELECT w, x, i + 2, xor(y.c >> 8, r.c) FROM crc y JOIN remainders r ON r.b = xor(y.c & 255, (instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, i + 2, 1)) - 1) WHERE i < length(x)),
bucket AS MATERIALIZED (SELECT w, xor(c, 4294967295) % {BUCKETS} AS b FROM crc WHERE i = length(x)),
ours AS (SELECT b, sum(n) AS s FROM words JOIN bucket USING (w) GROUP BY 1),
theirs AS (SELECT b, sum(n) AS t FROM aims JOIN bucket USING (w) GROUP BY 1),
gains AS MATERIALIZED (SELECT b, CAST(floor({SCALE} * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM ours)::DOUBLE + {BUCKETS}) / ((s::DOUBLE + 1) * ((SELECT sum(t) FROM theirs)::DOUBLE + {BUCKETS})))) AS BIGINT) AS g FROM ours LEFT JOIN theirs USING (b)),
weights AS (SELECT r, sum(n * g) AS weight FROM words JOIN bucket USING (w) JOIN gains USING (b) GROUP BY 1),
scored AS MATERIALIZED (SELECT doc_id, len(ws) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-{SCALE} * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM (
  SELECT *, list_reduce(list_transform(range(1, 9), lambda k: CAST(instr('0123456789abcdef', substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), k, 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)::DOUBLE AS h FROM docs) LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features < {LEAST_WORDS}, score DESC, doc_id NULLS LAST, n_features) AS k, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND k <= {PERCENT} * n // 100 THEN k END AS rank FROM placed"""
}
