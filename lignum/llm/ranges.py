"""Numbers along a whole order: dense names of keys and running sums, range by range, none of them in one task.

Rows are dealt into ranges of the order and sorted there; each range is read once, as a stream of Arrow
batches, by a small helper that numbers within the range. Where a range begins is then known from one row
a range. A key with any number of rows is spread over ranges, as the rows' own place is the end of the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import written


def _dealt(rows: DataFrame, order: list[Column]) -> DataFrame:
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    return salted.repartitionByRange(*order, F.col("_salt")).sortWithinPartitions(*order, F.col("_salt")).drop("_salt")


def _begun(parts: DataFrame, starts: dict[str, list]) -> DataFrame:
    """``parts`` with what each range begins with; one row a range is sent to the tasks."""
    known = parts.sparkSession.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in starts.items()}))
    return parts.join(F.broadcast(known), "_part")


def _new(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where another key begins in a batch sorted by ``keys``, and its last key."""
    n, new = batch.num_rows, np.zeros(batch.num_rows, dtype=bool)
    for k in keys:
        col = batch.column(k)
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    new[0] = last != tuple(batch.column(k)[0].as_py() for k in keys)
    return new, tuple(batch.column(k)[n - 1].as_py() for k in keys)


def dense_names(rows: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Adds ``name``: equal numbers for equal ``keys``, from 1 without gaps, in the keys' order. ``keys`` hold no nulls."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, part = None, 0, TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                new, last = _new(b, keys, last)
                ranks = at + np.cumsum(new)
                at = int(ranks[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranks, pa.int64()), pa.array(np.full(b.num_rows, part, np.int64))], [*b.schema.names, name, "_part"])

    ddl = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{name}` long", "_part long"])
    parts = written(_dealt(rows, [F.col(k) for k in keys]).mapInArrow(ranked, ddl), "names")
    ends = parts.groupBy("_part").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"), F.max(name).alias("n")).orderBy("_part").collect()  # a row for each range
    starts, before, total = {"_part": [], "_start": []}, None, 0
    for e in ends:
        start = total - 1 if e["low"] == before else total
        starts["_part"].append(e["_part"])
        starts["_start"].append(start)
        before, total = e["high"], start + e["n"]
    return _begun(parts, starts).withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def running_sums(rows: DataFrame, group: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds the running sum of each column ``sums`` names, as its value names it, over the rows of a ``group`` in ``order``.

    A row's sum has its own value in it. Values are whole and not negative; ``group`` is a whole number, not null.
    """
    values, names = list(sums), list(sums.values())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, part = None, [0] * len(values), TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                new, last = _new(b, [group], last)
                begins = np.flatnonzero(new)
                which = np.cumsum(new)  # 0: the group goes on from the batch before
                out = []
                for i, v in enumerate(values):
                    total = np.cumsum(b.column(v).to_numpy(zero_copy_only=False).astype(np.int64))
                    base = np.concatenate([[-held[i]], np.concatenate([[0], total])[begins]])
                    out.append(total - base[which])
                held = [int(x[-1]) for x in out]
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.int64()) for x in out], pa.array(np.full(b.num_rows, part, np.int64))], [*b.schema.names, *names, "_part"])

    ddl = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{n}` long" for n in names] + ["_part long"])
    parts = written(_dealt(rows, [F.col(group), *order]).mapInArrow(added, ddl), "sums")
    ends = parts.groupBy("_part").agg(F.min(group).alias("low"), F.max(F.struct(group, *names)).alias("high")).orderBy("_part").collect()  # a row for each range
    starts = {k: [] for k in ("_part", "_low", *[f"_{n}" for n in names])}
    before, carry = None, [0] * len(names)
    for e in ends:
        here = carry if e["low"] == before else [0] * len(names)
        starts["_part"].append(e["_part"])
        starts["_low"].append(e["low"])
        for n, c in zip(names, here, strict=True):
            starts[f"_{n}"].append(c)
        before, tail = e["high"][0], list(e["high"][1:])
        carry = [t + c for t, c in zip(tail, here, strict=True)] if before == e["low"] else tail
    whole = _begun(parts, starts)
    for n in names:
        whole = whole.withColumn(n, F.col(n) + F.when(F.col(group) == F.col("_low"), F.col(f"_{n}")).otherwise(0))
    return whole.drop(*starts)
