"""A keyed table that streams write to: buckets of the key, versions of buckets, and the position that is committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.operators import log as logs
from lignum.session import shared_folder, stored
from lignum.streaming.replay import hadoop

ROWS = "id long, seq long, op string, parent long, content long"


class KeyedTable:
    """The current state of a change log: the latest change of each id.

    A batch is folded, and with it only the buckets that it touches are written anew, under the batch's number.
    Then a small manifest says for each bucket which version counts; once it is complete the batch is
    committed. A new object on the same ``folder`` goes on from the last complete manifest, so after a crash half
    way a batch is done again from the same state, and a batch that has been committed is passed over.

    ``guard`` may refuse a batch (a mass removal): it is written aside and the state stays. A version that
    was replaced is deleted two commits later, so readers keep theirs that long. ``buckets`` holds for
    the life of a table: choose it so that a bucket is what one task can fold.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64, guard: Callable[[DataFrame, DataFrame], bool] | None = None):
        self.spark, self.folder, self.buckets, self.guard = spark, folder or shared_folder(spark, "keyed"), buckets, guard

    def _numbers(self, kind: str) -> list[int]:
        fs, at = hadoop(self.spark, f"{self.folder}/{kind}")
        if not fs.exists(at):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if fs.exists(path(f.getPath(), "_SUCCESS")))

    @property
    def position(self) -> int | None:
        """The number of the last batch that is committed."""
        return max(self._numbers("manifest"), default=None)

    @property
    def refused(self) -> list[int]:
        return self._numbers("refused")

    def _manifest(self, number: int | None) -> list:
        """A row for each bucket that has rows: its version, and the one replaced by this commit."""
        return [] if number is None else self.spark.read.schema("bucket int, version long, old long").parquet(f"{self.folder}/manifest/{number}").collect()

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[f"{self.folder}/data/{v}/bucket={b}" for b, v in sorted(versions.items())])

    def read(self) -> DataFrame:
        """The state as of the last committed batch."""
        return self._rows({r["bucket"]: r["version"] for r in self._manifest(self.position)})

    def apply(self, batch: DataFrame, number: int) -> None:
        """Folds a batch in, unless it has been; for ``foreachBatch``."""
        last = self.position
        if last is not None and number <= last:
            return
        before = self._manifest(last)
        versions = {r["bucket"]: r["version"] for r in before}
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        folded = logs.fold(batch).withColumn("bucket", bucket).persist()
        touched, changed = [r["bucket"] for r in folded.select("bucket").distinct().collect()], {}  # no more than there are buckets
        if self.guard and self.guard(folded.drop("bucket"), self.read()):
            folded.drop("bucket").write.mode("overwrite").parquet(f"{self.folder}/refused/{number}")
        elif touched:
            held = self._rows({b: versions[b] for b in touched if b in versions})
            state = logs.fold(held.unionByName(folded.drop("bucket"))).withColumn("bucket", bucket)
            state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{number}")
            changed = {b: versions.get(b) for b in touched}
        folded.unpersist()
        rows = [(b, number if b in changed else versions[b], changed.get(b)) for b in sorted({*versions, *changed})]
        self.spark.createDataFrame(rows, "bucket int, version long, old long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{number}")
        fs, _ = hadoop(self.spark, self.folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for r in before:  # what the commit before this one replaced
            if r["old"] is not None:
                fs.delete(path(f"{self.folder}/data/{r['old']}/bucket={r['bucket']}"), True)


class Publisher:
    """Appends batches to a log under sequence numbers of its own, in order over batches.

    A row held back upstream gets a number above all that have been given out, so a client that resumes from any
    number it has seen still gets it. A batch is numbered in the order ``by``; what it begins with is read from the
    last number of the batches before, so that running one again gives the same.
    """

    def __init__(self, spark: SparkSession, by: list[str], folder: str | None = None):
        self.spark, self.by, self.folder = spark, by, folder or shared_folder(spark, "published")

    def issued(self, before: int) -> DataFrame:
        """``batch, last``: the last number given out by the end of each batch before that one."""
        fs, at = hadoop(self.spark, f"{self.folder}/issued")
        if not fs.exists(at):
            return self.spark.createDataFrame([], "batch long, last long")
        return self.spark.read.schema("batch long, last long").parquet(f"{self.folder}/issued").filter(F.col("batch") < before)

    def apply(self, batch: DataFrame, number: int) -> None:
        start = self.issued(number).agg(F.max("last")).first()[0] or 0
        batch = stored(batch, "batch")  # numbering reads it more than once, and a stream's state would be gone over each time
        rows = logs.numbered(batch, *self.by).withColumn("at", F.col("at") + start).withColumnRenamed("at", "issued")
        rows.write.mode("overwrite").parquet(f"{self.folder}/log/batch={number}")
        last = self.spark.read.parquet(f"{self.folder}/log/batch={number}").agg(F.coalesce(F.max("issued"), F.lit(start)).alias("last"))
        last.select(F.lit(number).cast("long").alias("batch"), F.col("last").cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/issued/of={number}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log").drop("batch")


class OpLog:
    """Ops of a stream done once: a repeat within ``ttl_ns`` of one of the last ``most`` ops done is passed over.

    Batches have ``op, done_ns``. An op that comes several times in one batch counts once, at the first time that isn't
    a repeat of an earlier batch, so a batch should span less than ``ttl_ns``. Ops done are numbered in order of time and op, over batches;
    of those before, a batch reads only the ones that ``most`` still reaches. A batch that runs again gives the
    same. Rows without an op or a time are left out.
    """

    def __init__(self, spark: SparkSession, ttl_ns: int, most: int, folder: str | None = None):
        self.spark, self.ttl_ns, self.most = spark, ttl_ns, most
        self.done = Publisher(spark, ["done_ns", "op"], folder)

    def _held(self, number: int) -> DataFrame | None:
        issued = self.done.issued(number)
        start = issued.agg(F.max("last")).first()[0] or 0
        since = issued.filter(F.col("last") > start - self.most).agg(F.min("batch")).first()[0]
        if since is None or not start:
            return None
        log = self.spark.read.parquet(f"{self.done.folder}/log")
        return log.filter((F.col("batch") >= since) & (F.col("batch") < number) & (F.col("issued") > start - self.most)).select("op", F.col("done_ns").alias("before"))

    def apply(self, batch: DataFrame, number: int) -> None:
        rows = batch.select("op", "done_ns").filter("op IS NOT NULL AND done_ns IS NOT NULL")
        held = self._held(number)
        if held is not None:
            rows = rows.join(held.withColumnRenamed("op", "held"), (F.col("op") == F.col("held")) & (F.col("done_ns") - F.col("before") <= self.ttl_ns), "left_anti")
        self.done.apply(rows.groupBy("op").agg(F.min("done_ns").alias("done_ns")), number)

    def read(self) -> DataFrame:
        """``op, done_ns, issued`` of all ops done."""
        return self.done.read()
