"""Word-shingle sets as sorted 64-bit hashes, and their min-max signatures."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
BASE = 0xD1342543DE82EF95


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as texts have needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            step = np.full(n, BASE, dtype=np.uint64)
            back = np.full(n, pow(BASE, -1, 2**64), dtype=np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up, self.down


_powers = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M3
    x = (x ^ (x >> np.uint64(27))) * M1
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a 64-bit hash, the first byte, the byte after the last) of each word [^\x20\x09-\x0D]+ of a text, A-Z lower-cased.

    Hashes are differences of one running sum of bytes times powers.
    """
    data = LOWER[np.frombuffer(text, dtype=np.uint8)]
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = SPACE[data]
    turn = gap[1:] != gap[:-1]
    edges = np.flatnonzero(turn)
    start, end = edges[0::2], edges[1::2]
    up, down = _powers.upto(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * M2), start, end


def stretch_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch h[start:end] of word hashes."""
    up, down = _powers.upto(len(h) + 1)
    run = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * M2)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct `width`-word shingles of the lower-cased (A-Z) text; with fewer words the whole sequence is one; without words, empty."""
    h = words_of(text or b"")[0]
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(h) - width + 1)
    code = np.full(n, min(width, len(h)), dtype=np.uint64)
    for k in range(min(width, len(h))):
        code = mix(code * M2 + h[k : k + n])
    return np.unique(code)


class MinMax:
    """Minimum and maximum of a set under each of `permutations` random maps, cut into bands.

    Each map is a multiplication by an odd number and an addition modulo 2^32, on hashes that are already mixed;
    one evaluation gives two signature values. A band is `rows` values, minima and maxima in turn.
    """

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, n = bands, rows, bands * rows // 2
        self.a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * M2)

    def signature(self, x: np.ndarray) -> np.ndarray:
        x = (x >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, dtype=np.uint32)
        high = np.zeros(len(self.a), dtype=np.uint32)
        for at in range(0, len(x), 1024):
            y = np.multiply.outer(x[at : at + 1024], self.a)
            y += self.b
            np.minimum(low, y.min(axis=0), out=low)
            np.maximum(high, y.max(axis=0), out=high)
        return np.stack([low, high], axis=1).ravel().astype(np.uint64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One 64-bit key a band."""
        s = self.signature(x).reshape(self.bands, self.rows)
        key = self.salt.copy()
        for k in range(self.rows):
            key = mix(key * M2 + s[:, k])
        return key.view(np.int64)


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y|, exactly, of sorted sets."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def common(x: np.ndarray, y: np.ndarray) -> int:
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    return int(np.count_nonzero(z[1:] == z[:-1]))
