"""What the operators on embeddings share: which vectors count, pseudo-random rotations, and tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 3


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as rows of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        x = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def signs(count: int, width: int, seed: int) -> np.ndarray:
    """Random signs of ``count`` rotations."""
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], size=(count, ROUNDS, width))


def rotated(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """A pseudo-random rotation of each row: sign flips and Hadamard transforms in turn."""
    for f in flips:
        x = hadamard(x * f)
    return x


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def power_of_two(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def axis_codes(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: its number, plus the width if negative."""
    at = np.abs(x).argmax(axis=1)
    return at + np.where(x[np.arange(len(x)), at] < 0, x.shape[1], 0)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with the same keys from batches sorted by them, across batches."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch[k].to_pylist() for k in keys], strict=True))
        cuts = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
        for low, high in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if waiting and rows[low] != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(low, high - low))
            last = rows[low]
    if waiting:
        yield pa.Table.from_batches(waiting)
