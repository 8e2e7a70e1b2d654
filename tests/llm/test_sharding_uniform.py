"""The shuffle into shards is uniform: every order of the rows is equally likely."""

from collections import Counter

import numpy as np

from brindle.llm import sharding


def shuffled(counts, sizes, seed):
    """Slots of all rows, as tasks and windows would give them."""
    rows = []
    for part, n in enumerate(counts):
        owed, draw = sharding.owed_blocks(counts, sizes, part, seed)
        keys = draw.integers(0, 1 << 63, n)
        rows += [(b, k, part, at) for at, (b, k) in enumerate(zip(owed.tolist(), keys.tolist()))]
    return tuple((part, at) for _, _, part, at in sorted(rows))


def test_all_orders_are_equally_likely():
    counts, sizes = np.array([2, 0, 1, 1]), np.array([1, 2, 1])
    runs = 4_800
    seen = Counter(shuffled(counts, sizes, seed) for seed in range(runs))
    assert len(seen) == 24
    chi = sum((n - runs / 24) ** 2 / (runs / 24) for n in seen.values())
    assert chi < 50  # 23 degrees of freedom: beyond this with a probability of 1e-3


def test_large_draws_follow_the_law(monkeypatch):
    draw = np.random.default_rng(1)
    ours = np.array([sharding._large_draw(700, 300, 200, draw) for _ in range(20_000)])
    numpy = draw.hypergeometric(700, 300, 200, 20_000)
    assert abs(ours.mean() - 140) < 0.2 and abs(ours.std() / numpy.std() - 1) < 0.03
    assert all(sharding._large_draw(a, b, n, draw) == k for a, b, n, k in ((5, 0, 3, 3), (0, 5, 3, 0), (4, 4, 8, 4), (4, 4, 0, 0)))
    big = sharding._large_draw(10**10, 10**10, 10**9, draw)
    assert abs(big - 5 * 10**8) < 10**6
    monkeypatch.setattr(sharding, "MOST_AT_ONCE", 8)
    counts, sizes = np.array([7, 0, 13, 20]), np.array([11, 9, 20])
    m = sharding.communication_matrix(counts, sizes, 3)
    assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all()
