"""Tracks of small frames are followed without arrays, with the result of arrays."""

import random

import numpy as np

from brindle.operators import tracking


def test_small_frames_without_arrays(monkeypatch):
    draw = random.Random(4)

    def frame():
        made = []
        for _ in range(draw.choice([1, 1, 2, 5])):
            x, y = draw.randint(0, 6), draw.randint(0, 6)
            box = None if draw.random() < 0.1 else (float(x), float(y), x + draw.choice([-1.0, 0.0, 6.0, 9.0, np.nan]), float(y + draw.randint(0, 9)))
            made.append(tracking.Instance(None, draw.randint(0, 1), 0, box, None))
        return made

    frames = [f for f in (frame() for _ in range(600)) if f[0].box is not None]

    def tracks():
        known, following, made = [], 0, []
        for f in frames:
            known, found, following = tracking.follow(known, following, f)
            made.append((found, [(o.track, o.left) for o in known]))
        return made

    with np.errstate(all="ignore"):
        arrays, plain = [], tracking._box_overlaps
        monkeypatch.setattr(tracking, "_box_overlaps", lambda *a: (arrays.append(a), plain(*a))[1])
        quick = tracks()
        assert not [a for a in arrays if len(a[0]) * len(a[1]) <= 64]
        monkeypatch.setattr(tracking, "FEW", 0)
        assert tracks() == quick and arrays
