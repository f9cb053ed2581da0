"""Words of whole texts as flat numpy arrays: where they lie, and a 64-bit hash of each.

A word's hash is the sum of one random number per (position, byte). For fixed random numbers two
given words agree with probability 2**-64. Words longer than the table are hashed by BLAKE2.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_POSITIONS = 32
_SPANS = 100_000
_TABLE = np.random.Generator(np.random.PCG64(20240601)).integers(
    0, 1 << 64, (_POSITIONS, 256), np.uint64, endpoint=False).ravel()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the bounds of each; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words end at white space and at the end of their text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    solid = ~space
    return np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span; spans ascend and do not overlap."""
    hashes = np.zeros(len(starts), np.uint64)
    # A few spans at a time: the work arrays are eight times the size of the bytes.
    for a in range(0, len(starts), _SPANS):
        hashes[a:a + _SPANS] = _hash_some(data, starts[a:a + _SPANS], ends[a:a + _SPANS])
    return hashes


def _hash_some(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    upto = np.cumsum(sizes)
    first = upto - sizes
    place = np.arange(upto[-1], dtype=np.int64)
    slot = place - np.repeat(first, sizes)
    slot &= _POSITIONS - 1
    slot <<= 8
    place += np.repeat(starts - first, sizes)
    slot += data[place]
    filled = sizes > 0
    hashes = np.zeros(len(starts), np.uint64)
    if filled.any():
        hashes[filled] = np.add.reduceat(_TABLE[slot], first[filled])
    for i in np.flatnonzero(sizes > _POSITIONS):
        own = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = np.frombuffer(own, np.uint64)[0]
    return hashes


def counts_per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of words in each text."""
    return np.diff(np.searchsorted(starts, bounds))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible structure."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return values ^ (values >> np.uint64(31))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F], np.uint64)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a text, and their number per text.

    A text with fewer words is one run; a text without words has none.
    """
    n = len(hashes)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, np.uint64), number
    first = np.cumsum(counts) - counts
    at = np.arange(int(number.sum())) + np.repeat(first - (np.cumsum(number) - number), number)
    left = np.repeat(first + counts, number) - at
    out = np.zeros(len(at), np.uint64)
    whole = bool((counts[counts > 0] >= size).all())
    with np.errstate(over="ignore"):
        for j in range(size):
            term = mix(hashes[np.minimum(at + j, n - 1)] + _ODD[j]) * _ODD[j]
            out += term if whole else np.where(left > j, term, np.uint64(0))
    return mix(out), number
