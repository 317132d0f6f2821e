"""Tables replayed as streams in a stated order, and bounded snapshots of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lignum.operators.log import numbered
from lignum.operators.tree import paths
from lignum.session import shared_folder, stored


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _file_order(spark: SparkSession, folder: str, begin_ms: int) -> int:
    """Gives the data files not dated yet times in order of their names, a second apart; a stream reads older files first."""
    fs, at = hadoop(spark, folder)
    files = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getModificationTime() >= begin_ms), key=lambda p: p.getName())
    for i, f in enumerate(files):
        fs.setTimes(f, begin_ms - (1_000_000 - i) * 1000, -1)
    return len(files)


def replayed(df: DataFrame, *order: str, files: int = 8, per_batch: int = 1, closing: DataFrame | None = None) -> DataFrame:
    """``df`` as a stream that reads ``order`` range by range, ``per_batch`` files a micro-batch; ``closing`` rows come last, alone.

    Ranges are files of their own, so what a micro-batch holds is bounded by the number of files. Rows that only move
    the watermark past all others can be given as ``closing``.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "replay")
    clock = lambda: int(spark._jvm.System.currentTimeMillis()) - 1000
    df.repartitionByRange(files, *order).write.parquet(folder)
    now = clock() - 3_600_000
    _file_order(spark, folder, now)
    if closing is not None:
        closing.select(df.columns).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def entry_bytes() -> F.Column:
    """What an entry takes in a listing: its name and a fixed rest."""
    return (F.octet_length("name") + 64).cast("long")


def snapshot_chunks(tree: DataFrame, bound: int) -> DataFrame:
    """``chunk, id, parent, name, depth, bytes`` of a tree's rows that hang together with the root: parents before children, chunks of ``bound`` bytes at most.

    Rows in order of depth, folder, name and id are summed up in ranges, and those that begin within the same half
    bound make a chunk. As no row takes more than half the bound, which is checked, no chunk exceeds it.
    """
    rows = paths(tree.select("id", "parent", "name")).filter("depth IS NOT NULL").select("id", "parent", "name", "depth", entry_bytes().alias("bytes"))
    rows = numbered(rows, F.asc("depth"), F.asc_nulls_first("parent"), F.asc("name"), F.asc("id"))
    block = F.floor((F.col("at") - 1) / 10_000)
    sized = stored(rows.withColumn("block", block), "snapshot")
    if (sized.agg(F.max("bytes")).first()[0] or 0) * 2 > bound:
        raise ValueError("an entry takes more than half the bound of a chunk")
    inner = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy("block").agg(F.sum("bytes").alias("own"))  # a row for 10,000 rows
    before = before.select("block", F.coalesce(F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    begun = sized.withColumn("inner", F.coalesce(F.sum("bytes").over(inner), F.lit(0))).join(before, "block")
    return begun.select(F.floor((F.col("before") + F.col("inner")) / (bound // 2)).alias("chunk"), "id", "parent", "name", "depth", "bytes")


#: A micro-batch of a snapshot takes as many chunks as fit in this many bytes, and one at least.
BATCH_BYTES = 128 << 20


def snapshot_stream(tree: DataFrame, bound: int, batch_bytes: int | None = None) -> DataFrame:
    """A tree as a stream of chunks of ``bound`` bytes at most, parents before their children; ``chunk`` comes last.

    A micro-batch holds whole chunks that follow one another, as many as ``batch_bytes`` allow, so the number of micro-batches and of
    files, each of which the driver dates, depends on the tree's size and not on how small its chunks are.
    """
    chunks = stored(snapshot_chunks(tree, bound), "chunks")
    each = max(1, (BATCH_BYTES if batch_bytes is None else batch_bytes) // bound)
    return chunk_stream(chunks.select("id", "parent", "name", "depth", "bytes", F.col("chunk").cast("long")), each)


def chunk_stream(rows: DataFrame, each: int = 1) -> DataFrame:
    """Rows as a stream whose micro-batches are its ``chunk``s, in their order, ``each`` of them at a time; ``chunk`` comes last.

    What a micro-batch takes is a file, written by one task.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "chunk-stream")
    rows = rows.select(*[c for c in rows.columns if c != "chunk"], "chunk").withColumn("micro_batch", F.floor(F.col("chunk") / each).cast("long"))
    rows.repartition("micro_batch").write.partitionBy("micro_batch").parquet(folder)
    fs, at = hadoop(spark, folder)
    begin = int(spark._jvm.System.currentTimeMillis()) - 1_000_000_000
    for d in fs.listStatus(at):
        if d.isDirectory() and d.getPath().getName().startswith("micro_batch="):
            for f in fs.listStatus(d.getPath()):
                fs.setTimes(f.getPath(), begin + 1000 * int(d.getPath().getName().removeprefix("micro_batch=")), -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder).drop("micro_batch")
