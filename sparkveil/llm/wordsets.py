"""Hashes of words and sets of word shingles, for Arrow batches.

A word's hash chains a bijective mixer over its 8-byte blocks, seeded by its length, so that words of up to 8 bytes never collide and
longer ones do only by chance; words beyond ``_BLOCKED`` bytes take a cryptographic digest. A shingle's chains the hashes of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import Chunk, chunks, mixed

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BLOCKED = 512
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], _U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_values(c: Chunk) -> np.ndarray:
    """A 64-bit value for each word of ``c``, whose words are found already."""
    size = c.ends - c.starts
    at_byte = np.ndarray((len(c.data) + 1,), "<u8", np.concatenate([c.data, np.zeros(16, np.uint8)]), 0, (1,))
    value = mixed(size.astype(_U) * _ODD)
    active, done = np.flatnonzero(size <= _BLOCKED), 0
    while len(active):
        left = size[active] - done
        active, left = active[left > 0], left[left > 0]
        value[active] = mixed(value[active] ^ (at_byte[c.starts[active] + done] & _MASKS[np.minimum(left, 8)]))
        done += 8
    for i in np.flatnonzero(size > _BLOCKED).tolist():
        value[i] = int.from_bytes(hashlib.blake2b(c.data[c.starts[i] : c.ends[i]].tobytes(), digest_size=8).digest(), "little")
    return value


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    """For each chunk of texts: the sorted distinct shingles of its texts in a row, and how many each has. A shorter text is one shingle."""
    for c in chunks(texts):
        c.data = LOWER[c.data]
        c.words()
        words = word_values(c)
        n = np.diff(c.word_offsets)
        k = np.minimum(n, shingle)
        number = np.where(n > 0, n - k + 1, 0)
        owner = np.repeat(np.arange(c.n), number)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number - c.word_offsets[:-1], number)
        length = k[owner]
        value = mixed(length.astype(_U) + _ODD)
        for j in range(shingle):
            more = np.flatnonzero(length > j) if len(length) and length.min() <= j else slice(None)
            value[more] = mixed(value[more] * _ODD + words[start[more] + j])
        order = np.lexsort((value, owner))
        value = value[order]  # owner is sorted as it is
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield c, value[new], np.bincount(owner[new], minlength=c.n)


def set_names(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set, as two arrays."""
    ends, out = np.cumsum(sizes), []
    for seed in (_U(1), _U(0xA5A5A5A5)):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(values * _ODD + seed), dtype=_U)])
        out.append(mixed(sums[ends] - sums[ends - sizes] + sizes.astype(_U) * seed))
    return out[0], out[1]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
