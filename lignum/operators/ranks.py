"""Exact percentiles by distributed selection: no task holds a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lignum.operators.log import numbered
from lignum.session import stored


def same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on columns that may be null; ``right`` has one row a group."""
    named = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else F.lit(True)
    return left.join(named, on, how).drop(*[f"_{c}" for c in by])


def nearest_ranks(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of each group: ``by`` and a column for each of ``ps``, whose values are shares (0 is the least).

    All rows are put in one order of group and value, in ranges of about equal size, and numbered there; a
    group's percentile is the row a stated number of places after the group's first. Equal values, also where they
    are a third of all rows, are spread over ranges. Null values are left out; a null in ``by`` is a group.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"))
    placed = stored(numbered(rows, *[F.asc_nulls_first(c) for c in by], "_v", "_salt").drop("_salt"), "ranks")
    groups = placed.groupBy(*by).agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("p"), F.greatest(F.lit(1), F.least(F.col("_n"), F.ceil(F.lit(p) * F.col("_n")))).cast("long").alias("k")) for name, p in ps.items()])
    places = groups.select(F.explode(wanted).alias("w"), "_first").select("w.p", (F.col("_first") + F.col("w.k") - 1).alias("at"))
    found = placed.join(places, "at")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("p") == name, F.col("_v"))).alias(name) for name in ps])
