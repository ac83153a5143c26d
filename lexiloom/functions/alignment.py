"""Alignment of two nearly equal strings in bounded time: which character of one stands for which of the other."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: Insertions and deletions that a stretch is compared for, before it is taken apart at its anchors.
MOST_EDITS = 200
#: Lengths of anchors, runs of characters that stand once in each string, tried in turn.
ANCHORS = (24, 12, 6)
#: Whether a character is white space; the last entry stands for all beyond.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def aligned(a: str, b: str) -> np.ndarray:
    """For each character of a the index of the one of b that it stands for, or -1; indices rise.

    White space takes no part, as tokens hold none. Strings that differ by up to
    MOST_EDITS insertions and deletions are aligned with the fewest possible. Beyond
    that they are cut at anchors, and each stretch is aligned by itself; a stretch
    that differs more, and has no anchor, stays unaligned. So time is in proportion to
    the length, times MOST_EDITS at most.
    """
    ca, cb = code_points(a), code_points(b)
    ia, ib = (np.flatnonzero(~_BLANK[np.minimum(c, len(_BLANK) - 1)]) for c in (ca, cb))
    ca, cb = ca[ia], cb[ib]
    out = np.full(len(a), -1, np.int32)
    if len(ca) == len(cb) and (ca == cb).all():
        out[ia] = ib
        return out
    x, y = (c.tobytes().decode("utf-32-le", "surrogatepass") for c in (ca, cb))
    todo = [(0, len(x), 0, len(y), 0)]
    while todo:
        x0, x1, y0, y1, tried = todo.pop()
        n = _equal(ca[x0:x1], cb[y0:y1])
        out[ia[x0 : x0 + n]] = ib[y0 : y0 + n]
        x0, y0 = x0 + n, y0 + n
        n = _equal(ca[x0:x1][::-1], cb[y0:y1][::-1])
        out[ia[x1 - n : x1]] = ib[y1 - n : y1]
        x1, y1 = x1 - n, y1 - n
        if x0 == x1 or y0 == y1:
            continue
        pairs = fewest_edits(x[x0:x1], y[y0:y1])
        if pairs is not None:
            for i, j in pairs:
                out[ia[x0 + i]] = ib[y0 + j]
            continue
        for k in range(tried, len(ANCHORS)):
            found = anchors(x[x0:x1], y[y0:y1], ANCHORS[k])
            if found:
                i0, j0 = x0, y0
                for i, j in found:
                    todo.append((i0, x0 + i, j0, y0 + j, k + 1))
                    i0, j0 = x0 + i, y0 + j
                todo.append((i0, x1, j0, y1, k + 1))
                break
    return out


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many characters agree from the first on; looked at in stretches of doubled length, so that it costs no more than what agrees."""
    n, at, size = min(len(x), len(y)), 0, 64
    while at < n:
        other = x[at : min(at + size, n)] != y[at : min(at + size, n)]
        if other.any():
            return at + int(other.argmax())
        at, size = at + size, 2 * size
    return n


def fewest_edits(a: str, b: str, most: int = MOST_EDITS) -> list[tuple[int, int]] | None:
    """Pairs of equal characters with the fewest insertions and deletions between; None if it takes more than `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    far = {1: 0}  # by diagonal, i - j: the furthest i that some edits reach
    trace = []
    for d in range(min(most, len(a) + len(b)) + 1):
        trace.append(dict(far))
        for k in range(-d, d + 1, 2):
            i = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            j = i - k
            while i < len(a) and j < len(b) and a[i] == b[j]:
                i, j = i + 1, j + 1
            far[k] = i
            if i >= len(a) and j >= len(b):
                return _pairs_back(trace, len(a), len(b))
    return None


def _pairs_back(trace: list[dict[int, int]], i: int, j: int) -> list[tuple[int, int]]:
    out = []
    for d in range(len(trace) - 1, -1, -1):
        far, k = trace[d], i - j
        before = k + 1 if k == -d or (k != d and far[k - 1] < far[k + 1]) else k - 1
        pi = far[before]
        pj = pi - before
        while i > pi and j > pj and i > 0 and j > 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        if d:
            i, j = pi, pj
    return out[::-1]


def anchors(a: str, b: str, size: int) -> list[tuple[int, int]]:
    """Where runs of `size` characters that stand once in each string do, as many as can be kept in order in both."""
    once = lambda s: {g: i for g, i in _places(s, size).items() if i >= 0}
    own, other = once(a), once(b)
    both = sorted((i, other[g]) for g, i in own.items() if g in other)
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(both)
    for n, (_, j) in enumerate(both):
        at = bisect_left(tails, j)
        back[n] = ends[at - 1] if at else -1
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(both[n])
        n = back[n]
    return out[::-1]


def _places(s: str, size: int) -> dict[str, int]:
    """The place of every run of characters, -1 if it has several."""
    out: dict[str, int] = {}
    for i in range(len(s) - size + 1):
        g = s[i : i + size]
        out[g] = -1 if g in out else i
    return out
