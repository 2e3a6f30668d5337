"""Exact Jaccard links between sets of a cell that share a band, for many cells at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from shelfmark.llm.words import mix

#: Bits of the token map of a set, and tokens that are looked up at once.
BITS, TOKENS = 512, 2_000_000


def banded(
    sets: np.ndarray, offs: np.ndarray, cell: np.ndarray, bands: Callable, num: int, den: int, groups: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j) that connect all sets of equal ``cell`` which share a key of ``bands`` and have
    den * intersection >= num * union.

    ``sets[offs[i]:offs[i + 1]]`` are the sorted different tokens of set i. Sets of equal ``groups``
    need no link. A set meets the next in its band, then the one after that, and so on; pairs that
    are connected already are passed over, and bands whose sets are all connected drop out.
    """
    key, row = bands(sets, offs)
    key = mix(key ^ mix(cell.astype(np.int64).view(np.uint64)[row]))
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    label = np.arange(len(offs) - 1) if groups is None else np.unique(groups, return_inverse=True)[1]
    compare, step = None, 1
    begin, size = _open(key, row, label)
    while len(begin):
        if compare is None:
            compare = _Compare(sets, offs, num, den)
        at = np.repeat(begin - np.cumsum(size - step) + size - step, size - step) + np.arange(int((size - step).sum()))
        i, j = row[at], row[at + step]
        apart = label[i] != label[j]
        i, j = compare.similar(np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart]))
        if len(i):
            yield i, j
            label = _joined(label, i, j)
        step += 1
        stays = size > step
        if step & (step - 1) == 0:  # now and then, as it takes a look at all members
            stays &= _mixed(begin, size, row, label)
        begin, size = begin[stays], size[stays]


def _open(key: np.ndarray, row: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the runs of equal keys with sets of different labels."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(key)))
    begin, size = begin[size > 1], size[size > 1]
    stays = _mixed(begin, size, row, label)
    return begin[stays], size[stays]


def _mixed(begin: np.ndarray, size: np.ndarray, row: np.ndarray, label: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(0, bool)
    edge = np.cumsum(size) - size
    own = label[row[np.repeat(begin - edge, size) + np.arange(int(size.sum()))]]
    return np.minimum.reduceat(own, edge) != np.maximum.reduceat(own, edge)


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links (i, j): the smallest label that links reach."""
    to = np.arange(int(label.max()) + 1)
    a, b = label[i], label[j]
    while True:
        least = np.minimum(to[a], to[b])
        before = to.copy()
        np.minimum.at(to, a, least)
        np.minimum.at(to, b, least)
        np.minimum.at(to, before[a], least)
        np.minimum.at(to, before[b], least)
        while (to[to] != to).any():
            to = to[to]
        if (to[a] == to[b]).all():
            return to[label]


class _Compare:
    """Exact comparison of many pairs of sets."""

    def __init__(self, sets: np.ndarray, offs: np.ndarray, num: int, den: int):
        self.offs, self.size, self.num, self.den = offs, np.diff(offs), num, den
        n = len(self.size)
        owner = np.repeat(np.arange(n), self.size)
        bit = (sets % np.uint64(BITS)).astype(np.int64)
        maps = np.zeros(n * (BITS // 8), np.uint8)
        np.bitwise_or.at(maps, owner * (BITS // 8) + (bit >> 3), np.uint8(1) << (bit & 7).astype(np.uint8))
        self.maps = maps.view(np.uint64).reshape(n, -1)
        #: tokens that share a bit with another token of their set
        self.slack = self.size - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)
        tokens, rank = np.unique(sets, return_inverse=True)
        self.rank, self.wide = rank.astype(np.int64), len(tokens)
        self.known = owner * self.wide + self.rank

    def similar(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of (i, j) that reach the similarity."""
        if not len(i):
            return i, j
        pair = np.unique(i * len(self.size) + j)
        i, j = pair // len(self.size), pair % len(self.size)
        si, sj = self.size[i], self.size[j]
        near = np.minimum(si, sj) * self.den >= self.num * np.maximum(si, sj)
        i, j = i[near], j[near]
        most = np.bitwise_count(self.maps[i] & self.maps[j]).sum(axis=1).astype(np.int64) + np.minimum(self.slack[i], self.slack[j])
        near = (self.num + self.den) * most >= self.num * (self.size[i] + self.size[j])
        i, j = i[near], j[near]
        hit = [np.zeros(0, bool)]
        ends = np.cumsum(self.size[i])
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
            hit.append(self._counted(i[at:to], j[at:to]))
            at = to
        hit = np.concatenate(hit)
        return i[hit], j[hit]

    def _counted(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.size[i]
        first = np.cumsum(n) - n
        token = self.rank[np.repeat(self.offs[i] - first, n) + np.arange(int(n.sum()))]
        asked = np.repeat(j, n) * self.wide + token
        place = np.minimum(np.searchsorted(self.known, asked), len(self.known) - 1)
        common = np.add.reduceat((self.known[place] == asked).astype(np.int64), first)
        return self.den * common >= self.num * (n + self.size[j] - common)
