"""Words of texts as 64-bit hashes, for a whole batch at once."""

from __future__ import annotations

import numpy as np

#: White space is the space and the bytes 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _powers


def hash_runs(data: np.ndarray, inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes marked ``inside`` that cross none of ``cuts``: (starts, ends, hashes)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, starts)
    size = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, size)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place]
    return starts, starts + size, mix(np.add.reduceat(value, begin) + size.astype(np.uint64))


def hash_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs longer than ``size`` bytes: their numbers and the hashes of their first bytes."""
    long = np.flatnonzero(ends - starts > size)
    out = np.zeros(len(long), np.uint64)
    for k in range(size):
        out += (data[starts[long] + k].astype(np.uint64) + np.uint64(1)) * powers(size)[k]
    return long, mix(out + np.uint64(size << 32))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z) and, for each text, the
    number of the first one (texts + 1)."""
    starts, _, hashes = hash_runs(LOWER[data], ~SPACE[data], offsets[:-1])
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; the whole sequence as one if there are fewer; none for none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    count = len(hashes) - n + 1
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + count])
    return out
