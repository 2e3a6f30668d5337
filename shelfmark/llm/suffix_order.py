"""Suffix array of the token streams of many pages, with the pages that hold a run of tokens.

Streams stand one after the other, each ended by a sign of its own, so no common prefix goes
beyond a page. Suffixes are put in order by doubling in numpy: the rank by 2k tokens is the rank of
the pair of ranks by k tokens. The ranks of all steps give the common prefix of neighbours.
"""

from __future__ import annotations

import numpy as np

from shelfmark.llm.words import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


def suffix_order(tokens: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): places in the streams with their signs (place p of page i is p + i), sorted by
    what follows, and the equal tokens of each suffix and the one before it (0 for the first)."""
    n = len(tokens) + len(offs) - 1
    ends = offs[1:] + np.arange(len(offs) - 1)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    kinds, number = np.unique(tokens, return_inverse=True)
    rank = np.empty(n, np.int64)
    rank[~is_end] = number
    rank[ends] = len(kinds) + np.arange(len(ends))
    ranks, step = [rank], 1
    while len(rank) and int(rank.max()) + 1 < n:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
        ranks.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        a[same] += 1 << level
        b[same] += 1 << level
    lcp[1:] = a - order[:-1]
    return order, lcp


def holders(order: np.ndarray, lcp: np.ndarray, tokens: np.ndarray, offs: np.ndarray, run: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, n): one place in ``tokens`` of each run of ``run`` tokens that ``need`` pages or more
    hold, and how many do. Suffixes of one run are neighbours that agree on ``run`` tokens."""
    ends = offs[1:] + np.arange(len(offs) - 1)
    page = np.searchsorted(ends, order)
    long = ends[page] - order >= run
    order, page, first = order[long], page[long], (lcp < run)
    # of suffixes too short for a run none agrees with a neighbour on one
    group = np.cumsum(first)[long]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(group * len(offs) + page)
    group_of, n = np.unique(pairs // len(offs), return_counts=True)
    heads = np.unique(group, return_index=True)[1]
    enough = n >= need
    at = order[heads][enough]
    return at - page[heads][enough], n[enough]


def run_hashes(tokens: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of the ``run`` tokens from each place on."""
    h = np.full(len(at), run, np.uint64)
    for k in range(run):
        h = mix((h ^ tokens[at + k].view(np.uint64)) * _STEP + np.uint64(k + 1))
    return h.view(np.int64)


def marked(tokens: np.ndarray, offs: np.ndarray, run: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, page): the places where one of the runs with the hashes ``windows`` begins."""
    at = np.arange(max(len(tokens) - run + 1, 0))
    page = np.searchsorted(offs, at, "right") - 1
    inside = at + run <= offs[page + 1] if len(at) else np.zeros(0, bool)
    at, page = at[inside], page[inside]
    hit = np.isin(run_hashes(tokens, at, run), windows)
    return at[hit], page[hit]


def spans_of(at: np.ndarray, page: np.ndarray, offs: np.ndarray, run: int) -> list[list[int]]:
    """Begin and end, one after the other, of the stretches that runs at ``at`` cover in each page."""
    cover = np.zeros(int(offs[-1]) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + run, -1)
    on = np.cumsum(cover)[:-1] > 0
    out = []
    for p in np.unique(page).tolist():
        own = np.concatenate([[0], on[offs[p] : offs[p + 1]].astype(np.int8), [0]])
        out.append((p, np.flatnonzero(np.diff(own)).tolist()))
    lists: list[list[int]] = [[] for _ in range(len(offs) - 1)]
    for p, spans in out:
        lists[p] = spans
    return lists
