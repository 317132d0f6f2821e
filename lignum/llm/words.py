"""Hashes of the words of many texts at once, from their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in chunks of about so many bytes.
CHUNK_BYTES = 1 << 18

_BYTE = np.random.default_rng(20_240_731).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_kept: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    if len(_kept.get(base, ())) < n:
        p = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        p[0] = 1
        _kept[base] = np.multiply.accumulate(p)
    return _kept[base]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each text's words begin among them (one more than there are texts).

    ``data`` holds the texts one after another, ``ends`` where each ends. A word's hash is a polynomial
    in its bytes, taken from running sums over the whole chunk; all modulo 2 ** 64.
    """
    n = len(data)
    space = _SPACE[data]
    begin, end = ~space, ~space
    begin[1:] &= space[:-1]
    first = ends[:-1][ends[:-1] < n]
    begin[first] = ~space[first]
    end[:-1] &= space[1:]
    last = ends[ends > 0] - 1
    end[last] = ~space[last]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * _powers(_BASE, n + 1)[:n][::-1], out=sums[1:])
        # Byte i weighs BASE ** (n - 1 - i); BASE is odd, so that weight has an inverse.
        own = (sums[stops] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), n + 1)[n - stops]
        found = mixed(own + (stops - starts).astype(np.uint64))
    return found, np.searchsorted(starts, np.concatenate([[0], ends]))


def chunks(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, ends) of a string column, in chunks; null counts as empty."""
    n = len(text)
    if not n:
        return
    text = text.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, stop, data[bounds[row] : bounds[stop]], bounds[row + 1 : stop + 1] - bounds[row]
        row = stop
