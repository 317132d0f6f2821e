"""The session settings that the engine expects."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Recursive walks may be this deep.
DEPTH = 4096
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": str(DEPTH),
}


def session(master: str | None = None, app: str = "lignum") -> SparkSession:
    """A session with these settings; cluster settings stay as submitted."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or a temporary one under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lignum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lignum/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage, and a lost executor costs a reread only."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys of more than HOT_ROWS rows are hot, the HOT most frequent of them at most.
HOT, HOT_ROWS = 1024, 20_000


def hot_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``many.join(one, key, how)`` for an inner or left join where any number of rows of ``many`` may share a key, or have none.

    The most frequent keys stay where they are and are joined with the few rows of ``one`` that they name; all others are
    shuffled, and no key of those has more than a HOT-th of the rows. Rows without a key match nothing and aren't shuffled.
    Keys are counted in ``counted``, where the rest of ``many`` is known to have each of them once.
    """
    key_of = F.col(key)
    counts = (many if counted is None else counted).filter(key_of.isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS)
    found = counts.orderBy(F.desc("n")).limit(HOT).collect()
    out = many.filter(key_of.isNotNull())
    if found:
        is_hot = key_of.isin([r[key] for r in found])
        out = out.filter(~is_hot).join(one.filter(~is_hot), key, how).unionByName(many.filter(is_hot).join(F.broadcast(one.filter(is_hot)), key, how))
    else:
        out = out.join(one, key, how)
    if how == "left":
        out = out.unionByName(many.filter(key_of.isNull()), allowMissingColumns=True)
    return out
