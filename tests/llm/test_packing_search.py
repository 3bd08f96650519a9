"""Bin completion against best fit, the waste bound and brute force."""

from __future__ import annotations

import numpy as np

from graphloom.llm import packing as P


def _fewest(sizes, capacity):
    """Brute force: every way to put the next item into a container or a new one."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[k]:
                place(k + 1, [*rooms[:j], rooms[j] - sizes[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_thousand_shards_never_need_more_than_best_fit():
    rng = np.random.default_rng(7)
    for k in range(1000):
        n, capacity = int(rng.integers(0, 60)), int(rng.choice([50, 1000, 4096]))
        sizes = np.clip((rng.uniform(0.02, 0.75, n) * capacity).astype(int), 1, capacity)
        boxes = P.pack(sizes, np.arange(n) + 100, capacity, budget=2000)
        assert sorted(i - 100 for b in boxes for i in b) == list(range(n)), k
        assert all(sum(int(sizes[i - 100]) for i in b) <= capacity for b in boxes)
        assert P.lower_bound(sizes, capacity) <= len(boxes) <= len(P.best_fit(sizes, capacity))


def test_small_shards_are_packed_as_well_as_can_be():
    rng = np.random.default_rng(3)
    better = 0
    for _ in range(150):
        sizes = np.sort(rng.integers(15, 62, 11))[::-1]
        want = _fewest(sizes.tolist(), 100)
        assert P.lower_bound(sizes, 100) <= want
        assert len(P.pack(sizes, np.arange(11), 100, budget=200_000)) == want
        better += want < len(P.best_fit(sizes, 100))
    assert better > 0


def test_hard_sizes_do_not_fall_behind_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(251, 501, 3300)
    assert len(P.pack(sizes, np.arange(len(sizes)), 1000)) <= len(P.best_fit(sizes, 1000))
