"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word, where words are parted by ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder, which is
    kept in the setting for later calls.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lignum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lignum/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage, and a lost executor costs a reread only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys with more than one in HOT_SHARE of all rows are joined by broadcast; fewer than HOT_SHARE keys can have so many.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, keys: DataFrame, key: str, size: str) -> DataFrame:
    """The inner join of ``rows`` with ``keys``, which has one row for each ``key`` and in ``size`` how many rows meet it.

    The rows of frequent keys stay where they are and meet a broadcast of fewer than ``HOT_SHARE`` rows,
    so that no task gets a hot key whole. ``keys`` is read three times.
    """
    total = keys.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(keys.filter(F.col(size) * HOT_SHARE > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(keys.filter(F.col(size) * HOT_SHARE <= total), key)
    return rows.join(hot, key).unionByName(rest)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(col, UPPER, UPPER.lower())


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body).getItem(0)


def map_batches(df: DataFrame, run, ddl: str) -> DataFrame:
    """``run`` takes an iterator of Arrow record batches and yields dicts of columns as ``ddl`` names them."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=schema)
        pa.default_memory_pool().release_unused()  # workers wait for their next task, and hold no more than they need

    return df.mapInArrow(mapped, ddl)
