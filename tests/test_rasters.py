"""Polygon fills and pasted masks against loops over every pixel, and growth against flooding from pixel to pixel."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import geometry
from brindle.functions.geometry import Box
from brindle.operators import rasters, regions

NAMES = "id long, polygons array<array<double>>"


def pixels_of(spark, rows, height, width):
    runs = rasters.polygon_runs(spark.createDataFrame(rows, NAMES), ["id"], "polygons", height, width)
    found = [(r.id, r.y, r.x) for r in rasters.run_pixels(runs, ["id"]).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_rectangles_and_odd_polygons(spark):
    rows = [
        (1, [[2.0, 1.0, 5.0, 1.0, 5.0, 4.0, 2.0, 4.0]]),
        (2, [[2.0, 1.0, 5.0, 1.0, 5.0, 4.0, 2.0, 4.0], [4.0, 2.0, 7.0, 2.0, 7.0, 6.0, 4.0, 6.0]]),  # overlapping: a union
        (3, [[-5.0, -5.0, 50.0, -5.0, 50.0, 50.0, -5.0, 50.0]]),  # the whole image
        (4, [[1.0, 1.0, 1.0, 1.0, 1.0, 1.0]]),
        (5, [[1.0, 1.0, 2.0, 2.0]]),
        (6, []),
        (7, None),
    ]
    found = pixels_of(spark, rows, 8, 9)
    square = lambda k, y0, y1, x0, x1: {(k, y, x) for y in range(y0, y1) for x in range(x0, x1)}
    assert found == square(1, 1, 4, 2, 5) | square(2, 1, 4, 2, 5) | square(2, 2, 6, 4, 7) | square(3, 0, 8, 0, 9)
    assert pixels_of(spark, [], 8, 9) == set()


def walked(polygon, height, width):
    """The fill by walking along every edge on the fine grid."""
    at = [(math.trunc(5 * x + 0.5), math.trunc(5 * y + 0.5)) for x, y in zip(polygon[::2], polygon[1::2])]
    changes = np.zeros((height + 1, width), int)
    for (xa, ya), (xb, yb) in zip(at, at[1:] + at[:1]):
        n = max(abs(xb - xa), abs(yb - ya))
        if not n:
            continue
        if (xa > xb) if abs(xb - xa) == n else (ya > yb):
            xa, ya, xb, yb = xb, yb, xa, ya
        steps = [(xa + t, math.floor(ya + (yb - ya) / n * t + 0.5)) if xb - xa == n else (math.floor(xa + (xb - xa) / n * t + 0.5), ya + t) for t in range(n + 1)]
        for (u, v), (u2, v2) in zip(steps, steps[1:]):
            column, rest = divmod(min(u, u2) - 2, 5)
            if u != u2 and rest == 0 and 0 <= column < width:
                changes[min(height, max(0, math.ceil((min(v, v2) - 2) / 5))), column] += 1
    return {(y, x) for y, x in np.argwhere(np.cumsum(changes, 0)[:height] % 2).tolist()}


def test_random_polygons(spark):
    draw = np.random.default_rng(4)
    rows = [(k, [(draw.uniform(-4, 24, 2 * n)).round(2).tolist() for n in draw.integers(3, 8, 2)]) for k in range(60)]
    want = {(k, y, x) for k, polygons in rows for p in polygons for y, x in walked(p, 17, 20)}
    assert pixels_of(spark, rows, 17, 20) == want


def test_extents_and_areas(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0, 4.0, 0.0, 4.0, 3.0], [1.0, 1.0, 3.0, 1.0, 3.0, 3.0, 1.0, 3.0]])], NAMES)
    row = df.select(geometry.polygons_area(F.col("polygons")).alias("a"), *geometry.polygons_bounds(F.col("polygons"))).first()
    assert tuple(row) == (10.0, 0.0, 0.0, 4.0, 3.0)
    box = Box(*(F.lit(float(v)) for v in (1, 1, 3, 3)))
    inside = rasters.run_extents(rasters.within_box(df.select("id", F.expr("slice(polygons, 2, 1)").alias("polygons")), ["id"], "polygons", box, 10), ["id"]).first()
    assert tuple(inside) == (1, 100, 0, 0, 10, 10)


def test_paste(spark):
    draw = np.random.default_rng(7)
    side, height, width = 6, 15, 19
    rows = [(k, draw.uniform(0, 1, side * side).tolist(), *(float(v) for v in (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(draw.uniform([-6, -6, 0.5, 0.5], [18, 14, 14, 14], (30, 4)))]
    want = set()
    for k, mask, x0, y0, x1, y1 in rows:
        m = np.array(mask).reshape(side, side)
        for y in range(height):
            for x in range(width):
                v, u = (y + 0.5 - y0) / (y1 - y0) * side - 0.5, (x + 0.5 - x0) / (x1 - x0) * side - 0.5
                value = sum(m[i, j] * (1 - abs(v - i)) * (1 - abs(u - j)) for i in range(side) for j in range(side) if abs(v - i) < 1 and abs(u - j) < 1)
                if value >= 0.5:
                    want.add((k, y, x))
    odd = [(90, [0.9] * 5, 0.0, 0.0, 9.0, 9.0), (91, None, 0.0, 0.0, 9.0, 9.0), (92, [0.9] * 36, 3.0, 3.0, 3.0, 9.0), (93, [0.9] * 36, None, 3.0, 3.0, 9.0), (94, [0.9] * 36, 100.0, 100.0, 120.0, 120.0)]
    df = spark.createDataFrame([*rows, *odd], "id long, mask array<double>, x0 double, y0 double, x1 double, y1 double")
    assert {tuple(r) for r in rasters.paste(df, ["id"], "mask", side, Box.of(), height, width).collect()} == want
    with pytest.raises(ValueError):
        rasters.paste(df, ["id"], "mask", side, Box.of(), height, width, 0.0)


def flooded(instance, person, part, classes):
    """Each labelled pixel in row order floods the free pixels of its class."""
    instance, person = instance.copy(), person.copy()
    for y, x in np.argwhere(instance).tolist():
        if (kind := classes.get(int(instance[y, x]))) is None:
            continue
        queue = deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for c in range(max(0, a - 1), min(len(part), a + 2)):
                for d in range(max(0, b - 1), min(len(part[0]), b + 2)):
                    if instance[c, d] == 0 and part[c, d] == kind:
                        instance[c, d], person[c, d] = instance[y, x], person[y, x]
                        queue.append((c, d))
    return instance, person


def test_growth(spark):
    draw = np.random.default_rng(11)
    rows, want, classes = [], {}, []
    for image in range(8):
        part = draw.integers(0, 3, (12, 14))
        instance = np.where(draw.random((12, 14)) < 0.08, draw.integers(1, 6, (12, 14)), 0)
        person = draw.integers(0, 4, (12, 14))
        of = {k: k % 3 for k in range(1, 5)}  # instance 5 has no class
        classes += [(image, k, c) for k, c in of.items()]
        grown = flooded(instance, person, part, of)
        for y, x in np.ndindex(12, 14):
            rows.append((image, y, x, *(int(a[y, x]) for a in (instance, person, part))))
            want[image, y, x] = tuple(int(a[y, x]) for a in grown)
    rows.append((9, 0, 0, 0, None, None))
    want[9, 0, 0] = (0, None)
    pixels = spark.createDataFrame(rows, "image_id long, y long, x long, instance long, person long, part long")
    got = regions.grow(pixels, spark.createDataFrame(classes, "image_id long, instance long, part long"))
    assert got.columns == pixels.columns and {(r.image_id, r.y, r.x): (r.instance, r.person) for r in got.collect()} == want
    empty = regions.grow(pixels.filter("false"), spark.createDataFrame(classes, "image_id long, instance long, part long"))
    assert empty.count() == 0
