"""The nearest candidate by cells against a loop over all."""

import numpy as np
import pytest

from brindle.operators import matching


def plain(points, candidates):
    made = {}
    for i, part, u, v in points:
        mine = [((u - a) ** 2 + (v - b) ** 2, k) for k, p, a, b in candidates if p == part] if None not in (part, u, v) else []
        if mine:
            made[i] = min(mine)
    return made


def spread(kind):
    draw = np.random.default_rng(8)
    if kind == "even":
        return draw.random((300, 2)), draw.random((200, 2))
    if kind == "clumped":  # most candidates in one corner, points far off and outside
        return np.vstack([draw.uniform(-3, 4, (150, 2)), draw.normal(0, 1e-4, (60, 2))]), np.vstack([draw.normal(0, 1e-4, (300, 2)), [[1.0, 1.0], [0.4, 0.9]]])
    return draw.integers(0, 4, (120, 2)) / 4, draw.integers(0, 5, (80, 2)) / 4  # ties and equal places


@pytest.mark.parametrize("kind", ["even", "clumped", "grid"])
def test_nearest(spark, kind):
    a, b = spread(kind)
    points = [(k, k % 3, float(u), float(v)) for k, (u, v) in enumerate(a)] + [(900, 7, 0.5, 0.5), (901, None, 0.5, 0.5), (902, 1, None, 0.5)]
    candidates = [(k, k % 2 + (k % 5 == 0), float(u), float(v)) for k, (u, v) in enumerate(b)] + [(950, 2, None, 0.0)]
    p = spark.createDataFrame(points, "id long, part long, u double, v double")
    c = spark.createDataFrame([(k, int(q), u, v) for k, q, u, v in candidates], "vertex long, part long, cu double, cv double")
    got = {r.id: (r.d2, r.vertex) for r in matching.nearest(p, c, "part").collect()}
    want = plain(points, [x for x in candidates if None not in x])
    assert got.keys() == want.keys()
    for k, (d2, vertex) in want.items():
        assert got[k][1] == vertex and got[k][0] == pytest.approx(d2)


def test_nearest_of_nothing(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0)], "id long, part long, u double, v double")
    c = spark.createDataFrame([(5, 1, 2.0, 0.0)], "vertex long, part long, cu double, cv double")
    assert [tuple(r) for r in matching.nearest(p, c, "part").collect()] == [(1, 5, 4.0)]
    for a, b in ((p.filter("false"), c), (p, c.filter("false"))):
        made = matching.nearest(a, b, "part")
        assert made.columns == ["id", "vertex", "d2"] and made.count() == 0
