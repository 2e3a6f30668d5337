"""Band links and packed keys next to plain Python."""

import numpy as np

from shelfmark.llm import near_groups
from shelfmark.llm.band_links import banded
from shelfmark.llm.paragraphs import minhash_signatures, tuned_bands


def _sets(rng, n):
    base = [set(rng.integers(0, 400, rng.integers(1, 40)).tolist()) for _ in range(n // 4)]
    sets = [set(), *base]
    while len(sets) < n:
        s = set(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 4)):
            s.add(int(rng.integers(0, 400)))
        sets.append(s)
    return [np.array(sorted(s), np.uint64) for s in sets]


def _groups(n, links):
    label = list(range(n))
    for i, j in links:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_banded_connects_the_pairs_of_a_band_exactly():
    rng = np.random.default_rng(7)
    bands = minhash_signatures(*tuned_bands(0.8, 0.9999))
    for _ in range(5):
        sets = _sets(rng, 160)
        cell = rng.integers(0, 3, len(sets))
        offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        key, row = bands(np.concatenate(sets), offs)
        held = [set(key[row == i].tolist()) for i in range(len(sets))]
        want = []
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if cell[i] == cell[j] and held[i] & held[j] and 100 * len(a & b) >= 80 * len(a | b):
                    want.append((i, j))
        got = [(int(i), int(j)) for a, b in banded(np.concatenate(sets), offs, cell, bands, 80, 100) for i, j in zip(a, b)]
        assert set(map(frozenset, got)) <= set(map(frozenset, want))
        assert _groups(len(sets), got) == _groups(len(sets), want)
        known = np.array(_groups(len(sets), want))
        assert not list(banded(np.concatenate(sets), offs, cell, bands, 80, 100, known))


def test_banded_takes_a_hot_band_and_empty_cells():
    bands = minhash_signatures(13, 3)
    one = np.arange(20, dtype=np.uint64)
    sets, offs = np.tile(one, 5000), np.arange(5001) * 20
    got = [np.stack(p) for p in banded(sets, offs, np.zeros(5000, np.int64), bands, 80, 100)]
    assert len(set(_ends(np.concatenate(got, axis=1), 5000))) == 1
    assert not list(banded(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), bands, 80, 100))


def _ends(links, n):
    to = np.arange(n)
    for _ in range(n):
        low = np.minimum(to[links[0]], to[links[1]])
        after = to.copy()
        np.minimum.at(after, links[0], low)
        np.minimum.at(after, links[1], low)
        if (after == to).all():
            return to.tolist()
        to = after


def test_packed_columns_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1500):
        ids = np.sort(rng.integers(-(1 << 63), 1 << 62, n))
        keys = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        a, b = near_groups._unpack(near_groups._pack((ids, keys)), 2)
        assert (a == ids).all() and (b.view(np.uint64) == keys).all()
