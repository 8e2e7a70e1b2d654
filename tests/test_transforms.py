"""Affine transforms of images, points and boxes against loops over every pixel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions.geometry import Box
from brindle.operators import transforms
from brindle.operators.transforms import Affine

H, W = 6, 9


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).random((H, W))


def table(spark, image):
    return spark.createDataFrame([(1, y, x, float(image[y, x])) for y, x in np.ndindex(image.shape)], "image_id long, y long, x long, value double")


def drawn(df):
    rows = df.collect()
    made = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.nan)
    for r in rows:
        made[r.y, r.x] = r.value
    assert len(rows) == made.size
    return made


def sampled(image, u, v, fill):
    """Four pixels around a place, with what lies outside."""
    at = lambda y, x: image[y, x] if 0 <= y < image.shape[0] and 0 <= x < image.shape[1] else fill
    i, j = math.floor(v - 0.5), math.floor(u - 0.5)
    p, q = v - 0.5 - i, u - 0.5 - j
    return (at(i, j) * (1 - q) + at(i, j + 1) * q) * (1 - p) + (at(i + 1, j) * (1 - q) + at(i + 1, j + 1) * q) * p


@pytest.mark.parametrize("degrees, expand, center", [(30, True, None), (200, True, None), (-75, False, None), (40, False, (2.0, 5.0)), (0, True, None)])
def test_rotation(spark, image, degrees, expand, center):
    one = spark.createDataFrame([(1,)], "image_id long")
    turn, height, width = transforms.rotated(H, W, F.lit(float(degrees)), expand, center)
    got = drawn(transforms.warp(table(spark, image), one, (H, W), turn.inverse(), height, width, fill=0.5))
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    h, w = (round(H * abs(c) + W * abs(s)), round(H * abs(s) + W * abs(c))) if expand else (H, W)
    assert got.shape == (h, w)
    (fx, fy), (tx, ty) = ((W / 2, H / 2), (w / 2, h / 2)) if expand or center is None else (center, center)
    for y, x in np.ndindex(h, w):
        p, q = x + 0.5 - tx, y + 0.5 - ty
        assert got[y, x] == pytest.approx(sampled(image, c * p - s * q + fx, s * p + c * q + fy, 0.5))
    if degrees == 0:
        assert np.allclose(got, image)


def test_quarter_turn_is_to_the_left(spark, image):
    one = spark.createDataFrame([(1,)], "image_id long")
    turn, height, width = transforms.rotated(H, W, F.lit(90.0))
    assert np.allclose(drawn(transforms.warp(table(spark, image), one, (H, W), turn.inverse(), height, width)), np.rot90(image))


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
def test_extent(spark, image, method):
    one = spark.createDataFrame([(1,)], "image_id long")
    x0, y0, x1, y1 = -1.3, 0.7, 7.9, 8.2
    cut = transforms.extent(Box(*(F.lit(v) for v in (x0, y0, x1, y1))), 5, 7)
    got = drawn(transforms.warp(table(spark, image), one, (H, W), cut.inverse(), F.lit(5), F.lit(7), method, "repeat", -1.0))
    wide = np.pad(image, 1, mode="edge")
    for y, x in np.ndindex(5, 7):
        u, v = x0 + (x + 0.5) * (x1 - x0) / 7, y0 + (y + 0.5) * (y1 - y0) / 5
        inside = 0 <= u < W and 0 <= v < H
        want = -1.0 if not inside else image[int(v), int(u)] if method == "nearest" else sampled(wide, u + 1, v + 1, None)
        assert got[y, x] == pytest.approx(want)


def test_compose_invert_and_boxes(spark):
    one = spark.range(1)
    turn, height, width = transforms.rotated(H, W, F.lit(33.0))
    whole = transforms.flipped(W).then(turn).then(transforms.resized((height, width), (40, 20)))
    x, y = F.lit(2.5), F.lit(1.25)
    steps = transforms.resized((height, width), (40, 20)).at(*turn.at(*transforms.flipped(W).at(x, y)))
    row = one.select(*whole.at(x, y), *steps, *whole.inverse().at(*whole.at(x, y))).first()
    assert tuple(row[:2]) == pytest.approx(tuple(row[2:4])) and tuple(row[4:]) == pytest.approx((2.5, 1.25))
    box = transforms.flipped(10).box(Box(*(F.lit(float(v)) for v in (1, 2, 4, 8))))
    assert tuple(one.select(*box.columns()).first()) == (6, 2, 9, 8)


def test_flat_transforms_and_empty_tables(spark, image):
    one = spark.createDataFrame([(1,)], "image_id long")
    flat = Affine.of(0, 0, 1, 0, 1, 0)
    assert one.select(flat.inverse().a.alias("a")).first().a is None
    assert (drawn(transforms.warp(table(spark, image), one, (H, W), flat.inverse(), F.lit(2), F.lit(3), fill=0.5)) == 0.5).all()
    assert transforms.warp(table(spark, image), one.filter("false"), (H, W), flat, F.lit(2), F.lit(3)).count() == 0
    with pytest.raises(ValueError):
        transforms.warp(table(spark, image), one, (H, W), flat, F.lit(2), F.lit(3), "cubic")
