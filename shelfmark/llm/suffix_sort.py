"""Deep-shallow sorting of byte strings of a fixed depth, many at once in numpy.

Shallow: multikey quicksort whose characters are eight bytes, down to a depth of sixteen.
Deep: what still agrees forms groups, ordered by blind tries. A trie is grown level by level
for all groups together: one string of a group is its path, every other one leaves it where
the two first differ and only that depth and the byte there are kept. Strings that leave at
the same place are a group of the next level.
"""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 2


def _words_at(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on as one number in text order."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    return np.ndarray((len(buf) + 8,), ">u8", padded.data, strides=(1,))


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, known: int = 0) -> np.ndarray:
    """Equal leading bytes of the strings at a and b, at most ``depth``; ``known`` are equal."""
    out = np.full(len(a), depth, np.int64)
    todo = np.arange(len(a))
    for at in range(known, depth, 8):
        x = words[a[todo] + at].astype(np.uint64) ^ words[b[todo] + at].astype(np.uint64)
        differs = x != 0
        if differs.any():
            zeros = 63 - np.floor(np.log2(x[differs].astype(np.float64))).astype(np.int64)
            out[todo[differs]] = np.minimum(at + (zeros >> 3), depth)
            todo = todo[~differs]
        if not len(todo):
            break
    return out


def equal_groups(buf: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """A group number per string ``buf[s:s + depth]``, -1 where no other string is equal.

    Every string must lie inside ``buf``.
    """
    out = np.full(len(starts), -1, np.int64)
    if len(starts) < 2:
        return out
    words = _words_at(buf)
    first = [words[starts + 8 * k].astype(np.uint64) for k in range(SHALLOW_WORDS)]
    order = np.lexsort(first[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for w in first:
        w = w[order]
        new[1:] |= w[1:] != w[:-1]
    members, group = order, np.cumsum(new) - 1
    numbered = 0
    while len(members):
        size = np.bincount(group)
        keep = size[group] > 1
        members, group = members[keep], group[keep]
        if not len(members):
            break
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        head = members[new][np.cumsum(new) - 1]  # the path of each trie
        lcp = common_prefix(words, starts[members], starts[head], depth, 8 * SHALLOW_WORDS)
        same = lcp == depth
        count = np.bincount(np.cumsum(new) - 1, weights=same)
        found = same & (count[np.cumsum(new) - 1] > 1)
        ids = np.unique(group[found], return_inverse=True)[1]
        out[members[found]] = numbered + ids
        numbered += int(ids.max()) + 1 if len(ids) else 0
        members, group, lcp = members[~same], group[~same], lcp[~same]
        if len(members):
            branch = buf[starts[members] + lcp]
            key = np.lexsort((branch, lcp, group))
            members, group, lcp, branch = members[key], group[key], lcp[key], branch[key]
            new = np.ones(len(key), bool)
            new[1:] = (group[1:] != group[:-1]) | (lcp[1:] != lcp[:-1]) | (branch[1:] != branch[:-1])
            group = np.cumsum(new) - 1
    return out
