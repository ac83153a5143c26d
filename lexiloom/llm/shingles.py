"""Word shingles as 64-bit hashes, and SuperMinHash signatures of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

#: Components of a signature: a prime, so that every step below is a permutation.
SIZE = 127
ROWS = 4
BANDS = SIZE // ROWS
#: Words a task remembers the hashes of.
REMEMBERED = 300_000

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingles of a text's lower-cased (A-Z) words; fewer words than `width` make one shingle, none make none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, _U)
    for i in range(n):
        total += mixed(h[i : len(h) - n + 1 + i] + _U(i)) * _ODD[i]
    return np.unique(mixed(total))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    a, b = mixed(shingles ^ _ODD[5]).sum(dtype=_U), mixed(shingles + _ODD[6]).sum(dtype=_U)
    return a.tobytes() + b.tobytes()


def signature(shingles: np.ndarray) -> np.ndarray:
    """SuperMinHash: component p is the least rank + fraction that an element puts there.

    Each element walks the components in an order of its own, (a + rank * b) mod
    SIZE, and puts rank plus a fraction drawn for (element, rank) at each: so one
    element's values fall into different strata, which makes components
    negatively correlated. Ranks are taken one by one for all elements at once,
    and the walk stops as soon as no later rank can lower any component.
    """
    none = np.int64(1) << 62
    out = np.full(SIZE, none, np.int64)
    a = (mixed(shingles ^ _ODD[3]) >> _U(33)).astype(np.int64) % SIZE
    b = (mixed(shingles ^ _ODD[4]) >> _U(33)).astype(np.int64) % (SIZE - 1) + 1
    place = a
    for rank in range(SIZE):
        value = (mixed(shingles + _U((0x589965CC75374CC3 * (rank + 1)) % 2**64)) >> _U(16)).astype(np.int64) | rank << 48
        np.minimum.at(out, place, value)
        if out.max() < (rank + 1) << 48:
            break
        place = place + b
        place[place >= SIZE] -= SIZE
    return out


def lanes(sig: np.ndarray) -> bytes:
    """A signature in 16 bits a component, for storage and estimates."""
    return (mixed(sig.astype(_U)) >> _U(48)).astype("<u2").tobytes()


def band_keys(stored: bytes) -> np.ndarray:
    """One 64-bit key for each band of ROWS components of a stored signature."""
    parts = np.frombuffer(stored, "<u2")[: BANDS * ROWS].astype("<u2").view("<u8")
    return mixed(parts.astype(_U) + np.arange(1, BANDS + 1, dtype=_U) * _ODD[2]).view(np.int64)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, on full sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
