"""Documents that share what is common, but nothing rare, never meet."""

import time

import numpy as np

from glyphmill.llm import neardup


def test_texts_that_share_one_shingle():
    start = time.perf_counter()
    sets = [neardup.shingles(f"thanks for the great post user{k}") for k in range(20_000)]
    found = neardup.group_components(neardup.SetIndex(sets))
    assert (found == np.arange(20_000)).all() and time.perf_counter() - start < 30


def test_links_equal_brute_force():
    """Common shingles, sets of all sizes and several limits; links to other components only, too."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 60, 30, dtype=np.uint64)
    for percent in (50, 75, 90, 100):
        sets = []
        for _ in range(150):
            own = np.concatenate((common[: rng.integers(0, 30)], rng.integers(0, 1 << 60, rng.integers(0, 8), dtype=np.uint64)))
            sets.append(np.unique(own) if len(own) else common[:1])
        index = neardup.SetIndex(sets, percent)
        component = rng.integers(0, 5, len(sets))
        mixed = index.mixed(component)
        for k, mine in enumerate(sets):
            both = [len(np.intersect1d(mine, s)) for s in sets]
            want = [j for j, s in enumerate(sets) if 100 * both[j] >= percent * (len(mine) + len(s) - both[j])]
            assert index.linked(k).tolist() == want
            assert index.linked(k, component, mixed).tolist() == [j for j in want if component[j] != component[k]]
