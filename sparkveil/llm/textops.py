"""Vectorised text kernels for Arrow batches: words, hashes of words and of windows, without a Python call per word.

A batch is cut into chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own). Within a chunk, the hash of any
byte range comes from prefix sums of ``T[byte] * B**i`` modulo 2**64; ``B`` is odd, so dividing by ``B**start`` is exact.
Hashes depend on content alone, so all executors agree on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_TABLE = seeded(256, 11)
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept up to 4 chunks long."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, 2 * CHUNK) + 1, base, _U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * CHUNK:
            _powers[base] = have
    return have


class Hasher:
    """Hashes of ranges of a sequence of bytes, or of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        values = _TABLE[values] if values.dtype == np.uint8 else values
        n = len(values)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * _power(_BASE, n)[:n], out=self.sums[1:])
        self.inverse = _power(_INVERSE, n)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Chunk:
    """Whole texts in a row: ``data`` holds their bytes, text i is ``data[offsets[i]:offsets[i + 1]]``; ``rows`` are their places in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, space: np.ndarray = _SPACE) -> None:
        """Sets starts and ends of words (bytes not in ``space``), and word_offsets: text i has words word_offsets[i] to word_offsets[i + 1]."""
        solid = np.zeros(len(self.data) + 2, bool)
        np.logical_not(space[self.data], out=solid[1:-1])
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        inside = solid[1:]
        self.starts = np.flatnonzero(inside[:-1] & (~solid[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[:-1] & (~solid[2:] | edge[1:])) + 1
        self.word_offsets = np.searchsorted(self.starts, self.offsets)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Per text, the sum of a 0/1 array over its bytes."""
        return np.diff(np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])[self.offsets])


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "").cast(pa.large_binary())


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """Of a large_binary array without nulls."""
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        yield Chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def spans_to_mask(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places the windows cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` values, the place of its smallest (the first of equal ones)."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = x.copy(), np.arange(len(x)), 1
    while span < width:  # doubling: best[i] covers x[i:i+span]
        step = min(span, width - span)
        right, left = best[step:], best[: len(best) - step]
        take = right < left
        at = np.where(take, at[step:], at[: len(at) - step])
        best = np.where(take, right, left)
        span += step
    return at[:n]
