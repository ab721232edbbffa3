"""Vectorised text kernels over the UTF-8 bytes of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240131))
#: A random 64-bit value for each byte, without and with A-Z read as a-z.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_VALUE_LOWER = BYTE_VALUE.copy()
BYTE_VALUE_LOWER[65:91] = BYTE_VALUE[97:123]
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i up to n, modulo 2 ** 64."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 16)
        for way, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[way] = np.multiply.accumulate(steps)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large_string column without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal content at any place."""
    return value_hashes(values[data], starts, ends)


def value_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As range_hashes, of 64-bit values."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _power(len(values))
    sums = np.empty(len(values) + 1, U)
    sums[0] = 0
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


#: Bytes that are neither ASCII letters and digits nor part of a longer character.
NOT_ALPHANUMERIC = np.ones(256, bool)
NOT_ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without separators, within a row), and each row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = separators[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[1:-1] = space[1:]
    edge[offsets] = True
    ends = np.flatnonzero(edge[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, given each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k words; a row of fewer words has its whole sequence as one, a row of none has none."""
    counts = np.diff(first)
    row = rows_of(first)
    spots = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
    room = np.repeat(counts, counts) - spots
    total = np.zeros(len(hashes), U)
    for j in range(k):
        step = np.zeros(len(hashes), U)
        step[: max(len(hashes) - j, 0)] = hashes[j:]
        total += np.where(room > j, mix(step + U(j + 1)) * U(2 * j + 3), U(0)) + np.where(room > j, U(0), U(0x51))
    keep = (room >= k) | ((spots == 0) & (room < k))
    return row[keep], mix(total[keep])


def distinct_in_rows(row: np.ndarray, value: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the row offsets."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.searchsorted(row[fresh], np.arange(n_rows + 1))


def factorize(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes, and an item of each code. Lengths join the key, so that unequal ones never meet."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, uniques = pd.factorize(hashes ^ mix(lengths.astype(U)))
    item = np.empty(len(uniques), np.int64)
    item[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, item


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + length]."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


def list_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), pa.array(values)).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))
