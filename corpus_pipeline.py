"""A corpus pipeline: language, near duplicates, mixing, tokens. Part of ``lignum.llm``.

Each stage takes what the stage before it kept, written as Parquet and read again. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm import bpe, language, mixing, ngram_join
from lignum.llm.common import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The near-duplicate stage takes five words and a similarity of 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language that was learned: null texts and those without a letter."""
    found = language.identify(docs, keep=COLUMNS)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, once; documents without shingles or id stay."""
    found = ngram_join.join(docs, NEAR_WORDS, NEAR_PERCENT)
    drop = found.filter("doc_id IS NOT NULL AND component_id <> doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(drop, "doc_id", "left_anti").select(*COLUMNS)
    # Rows that repeat an id and text are copies too. Keyed by the id, no group of copies meets here.
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(kept.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    Rows are told apart by a 128-bit hash of all their columns, nulls included, so rows without ids each
    count; rows that are alike in every column share their copies. Documents without words, null texts
    among them, are in no mix and are dropped. An empty table gives none; other columns are ignored.
    """
    marked = [x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]
    key = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(half), *marked)), 16, "0") for half in (0, 1)])
    keyed = docs.select(*COLUMNS, key.alias("key"))
    taken = mixing.mix(keyed, key="key").groupBy("key").agg(F.sum("copies").alias("copies"), F.max("size").alias("size")).filter("copies > 0 AND size > 0")
    rows = keyed.dropDuplicates(["key"]).join(taken.select("key", "copies"), "key")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document taken, as number and digests.

    One row for each row, repeated ones and those without ids included; a null text has no tokens. An empty
    table gives none; other columns are ignored.
    """
    return bpe.digests(docs, bpe.default_path())


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]
#: A learned model and random rounding can't be said in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
