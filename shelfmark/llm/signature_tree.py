"""Exact Jaccard links inside one cell of sets, by a tree of signatures.

A leaf holds a few sets, a node a few nodes. Each keeps the OR of its sets' token bitmaps and
the range of their sizes. A dual traversal compares node with node: sizes too far apart, or a
bitmap overlap that no pair below could turn into enough common tokens, end the branch. So
does a pair of nodes whose sets are all in one group already. Sets in leaves that are left are
counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 2048
LEAF, FAN = 8, 8


def linked(keys: np.ndarray, offs: np.ndarray, num: int, den: int, groups: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links (i, j) that connect all sets with den * intersection >= num * union.

    ``keys[offs[i]:offs[i + 1]]`` are the sorted different tokens of set i; empty sets link
    with nothing. ``groups`` are labels of sets that need no more links with one another.
    Only links between different groups come out, at most one less than there are sets.
    """
    sets = [keys[a:b] for a, b in zip(offs[:-1], offs[1:])]
    if len(sets) < 2:
        return
    label = np.arange(len(sets)) if groups is None else np.unique(groups, return_inverse=True)[1]
    size = np.diff(offs)
    if len(sets) == 2:
        if label[0] != label[1] and _similar(sets[0], sets[1], num, den):
            yield 0, 1
        return
    first = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    order = np.lexsort((size, first))
    order = order[size[order] > 0]
    tree = _Tree(sets, order, size)
    label = label.copy()
    # children meet among themselves before they meet others, so groups grow from below
    todo: list[tuple[int, int, int, bool]] = [(tree.top, 0, 0, False)]
    while todo:
        level, a, b, opened = todo.pop()
        if a == b and level and not opened:
            todo.append((level, a, b, True))
            todo += [(level - 1, c, c, False) for c in tree.children(level, a)]
            continue
        low_a, high_a = tree.span(level, a)
        low_b, high_b = tree.span(level, b)
        own = label[order[low_a:high_a]]
        if (own == own[0]).all() and (label[order[low_b:high_b]] == own[0]).all():
            continue
        if a != b and not tree.may_meet(level, a, b, num, den):
            continue
        if level:
            kids_a, kids_b = tree.children(level, a), tree.children(level, b)
            todo += [(level - 1, c, d, True) for c in kids_a for d in kids_b if a != b or c < d]
            continue
        for x in range(low_a, high_a):
            for y in range(max(low_b, x + 1) if a == b else low_b, high_b):
                i, j = order[x], order[y]
                if label[i] != label[j] and tree.close(x, y, num, den) and _similar(sets[i], sets[j], num, den):
                    label[label == label[j]] = label[i]
                    yield int(i), int(j)


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(both) - common)


class _Tree:
    """Levels of nodes over the sets in ``order``; level 0 are the leaves."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, size: np.ndarray):
        n = len(order)
        bits = np.zeros((n, BITS // 8), np.uint8)
        for r, i in enumerate(order):
            at = (sets[i] % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(bits[r], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        self.maps = bits.view(np.uint64)
        self.size = size[order]
        #: tokens that share a bit with another token of their set
        self.slack = self.size - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)
        self.n = n
        step, lo, hi, loose, maps = LEAF, self.size, self.size, self.slack, self.maps
        self.levels = []
        while True:
            at = np.arange(0, len(lo), step)
            maps = np.bitwise_or.reduceat(maps, at, axis=0)
            lo, hi, loose = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(loose, at)
            self.levels.append((maps, lo, hi, loose))
            if len(at) == 1:
                break
            step = FAN
        self.top = len(self.levels) - 1

    def span(self, level: int, node: int) -> tuple[int, int]:
        width = LEAF * FAN**level
        return node * width, min((node + 1) * width, self.n)

    def children(self, level: int, node: int) -> range:
        return range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][1])))

    def may_meet(self, level: int, a: int, b: int, num: int, den: int) -> bool:
        maps, lo, hi, loose = self.levels[level]
        if hi[a] * den < num * lo[b] or hi[b] * den < num * lo[a]:
            return False
        most = int(np.bitwise_count(maps[a] & maps[b]).sum()) + min(loose[a], loose[b])
        return (num + den) * min(most, hi[a], hi[b]) >= num * (lo[a] + lo[b])

    def close(self, x: int, y: int, num: int, den: int) -> bool:
        most = int(np.bitwise_count(self.maps[x] & self.maps[y]).sum()) + min(self.slack[x], self.slack[y])
        return (num + den) * most >= num * (self.size[x] + self.size[y])
