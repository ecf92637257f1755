"""Binary trie self-join over bit sketches.

Members of a block are sorted by their 256-bit sketch; a trie node is then a range of
the sorted rows whose depth is the common prefix of its first and last row. Node pairs
are walked together, all blocks of a batch at once: the bits in which the common
prefixes differ are counted, and a pair of nodes is dropped as soon as they exceed the
error budget of its largest members.
"""

from __future__ import annotations

import numpy as np

BITS = 256
WORDS = BITS // 64
#: A node pair with no more row pairs than this is compared row by row.
LEAF = 8


def _masks() -> np.ndarray:
    out = np.zeros((BITS + 1, WORDS), dtype=np.uint64)
    for d in range(BITS + 1):
        for w in range(WORDS):
            k = min(max(d - 64 * w, 0), 64)
            out[d, w] = ((1 << k) - 1) << (64 - k)
    return out


_MASK = _masks()


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity of the items that fall on each of 256 bits: two sketches differ in no more bits than their sets in items."""
    odd = np.bincount((items >> np.uint64(11)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">u8").astype(np.uint64)


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two sketches."""
    x = a ^ b
    for k in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(k)
    zeros = 64 - np.bitwise_count(x).astype(np.int64)
    out = zeros[:, 0].copy()
    for w in range(1, WORDS):
        out += np.where(out == 64 * w, zeros[:, w], 0)
    return out


def _split(rows: np.ndarray, start: np.ndarray, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First row of each range whose bit at ``depth`` is set."""
    lo, hi = start.copy(), end.copy()
    word, shift = depth // 64, (63 - depth % 64).astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        at = np.minimum(mid, len(rows) - 1)
        one = ((rows[at, word] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


class _Most:
    """Largest value of any range, by doubling tables."""

    def __init__(self, x: np.ndarray) -> None:
        self.levels = [x]
        while len(self.levels[-1]) > 1 and (1 << len(self.levels)) <= len(x):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-step], last[step:]))
        self.offsets = np.cumsum([0, *map(len, self.levels[:-1])])
        self.flat = np.concatenate(self.levels)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        k = np.frexp((end - start).astype(np.float64))[1] - 1
        return np.maximum(self.flat[self.offsets[k] + start], self.flat[self.offsets[k] + end - (1 << k)])


def _products(s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs of range pairs."""
    width = e2 - s2
    count = (e1 - s1) * width
    which = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return s1[which] + k // width[which], s2[which] + k % width[which]


def self_join(block: np.ndarray, rows: np.ndarray, size: np.ndarray, budget: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block whose sketches differ in at most budget[0] / budget[1] of the sum of their sizes.

    Returns the positions of both rows in the input.
    """
    order = np.lexsort((*(rows[:, w] for w in reversed(range(WORDS))), block))
    rows, size, block = rows[order], size[order].astype(np.int64), block[order]
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    s1, e1 = cut, np.r_[cut[1:], len(block)]
    many = e1 - s1 > 1
    s1, e1 = s1[many], e1[many]
    s2, e2 = s1.copy(), e1.copy()
    most = _Most(size)
    num, den = budget
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    while len(s1):
        same = s1 == s2
        d1, d2 = _prefix(rows[s1], rows[e1 - 1]), _prefix(rows[s2], rows[e2 - 1])
        common = np.minimum(d1, d2)
        wrong = np.bitwise_count((rows[s1] ^ rows[s2]) & _MASK[common]).sum(axis=1).astype(np.int64)
        keep = same | (wrong * den <= num * (most(s1, e1) + most(s2, e2)))
        leaf = keep & (((e1 - s1) * (e2 - s2) <= LEAF) | (common == BITS))
        if leaf.any():
            i, j = _products(s1[leaf], e1[leaf], s2[leaf], e2[leaf])
            ok = i != j
            ok &= ~(np.repeat(same[leaf], (e1[leaf] - s1[leaf]) * (e2[leaf] - s2[leaf])) & (i > j))
            i, j = i[ok], j[ok]
            near = np.bitwise_count(rows[i] ^ rows[j]).sum(axis=1).astype(np.int64) * den <= num * (size[i] + size[j])
            left.append(i[near])
            right.append(j[near])
        go = keep & ~leaf
        first = d1 <= d2  # split the node that branches earlier
        a = go & same
        b = go & ~same & first
        c = go & ~same & ~first
        ma, mb, mc = _split(rows, s1[a], e1[a], d1[a]), _split(rows, s1[b], e1[b], d1[b]), _split(rows, s2[c], e2[c], d2[c])
        s1, e1, s2, e2 = (
            np.concatenate([s1[a], s1[a], ma, s1[b], mb, s1[c], s1[c]]),
            np.concatenate([ma, ma, e1[a], mb, e1[b], e1[c], e1[c]]),
            np.concatenate([s1[a], ma, ma, s2[b], s2[b], s2[c], mc]),
            np.concatenate([ma, e1[a], e1[a], e2[b], e2[b], mc, e2[c]]),
        )
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]
