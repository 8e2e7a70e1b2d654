"""Boxes, labels and warps of key points against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import poses


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def point(x, y):
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))


def test_hand_box(spark):
    size = F.lit(400.0), F.lit(300.0)
    # Lower arm 100, upper arm 100: side 150, centre (233, 100).
    assert tuple(one(spark, poses.hand_box(point(0, 100), point(100, 100), point(200, 100), *size))) == (158, 25, 150)
    assert tuple(one(spark, poses.hand_box(point(180, 250), point(280, 250), point(350, 250), *size))) == (305, 182, 94)
    assert one(spark, poses.hand_box(point(0, 0), point(2, 0), point(4, 0), *size)) is None
    assert one(spark, poses.hand_box(F.lit(None).cast("struct<x:double,y:double>"), point(2, 0), point(4, 0), *size)) is None


def test_face_box(spark):
    size, none = (F.lit(400.0), F.lit(300.0)), F.lit(None).cast("struct<x:double,y:double>")
    assert tuple(one(spark, poses.face_box(point(200, 150), [point(210, 145), none], [none, none], *size))) == (170, 120, 60)
    assert tuple(one(spark, poses.face_box(point(10, 150), [point(20, 150), none], [point(50, 150), none], *size))) == (0, 90, 120)
    assert one(spark, poses.face_box(point(200, 150), [none], [none], *size)) is None
    assert one(spark, poses.face_box(none, [point(1, 1)], [none], *size)) is None


def test_heat_label(spark):
    box = tuple(F.lit(v) for v in (0.0, 0.0, 10.0, 20.0))
    at = lambda x, y, seen=2: tuple(one(spark, poses.heat_label(F.lit(float(x)), F.lit(float(y)), F.lit(seen), box, 4)))
    assert at(0, 0) == (0, True) and at(10, 20) == (15, True) and at(5, 10) == (10, True)
    assert at(10.5, 3) == (0, False) and at(-1, 3) == (0, False) and at(5, 10, 0) == (0, False)


def test_warp(spark):
    k = one(spark, poses.center_scale(tuple(F.lit(v) for v in (0.0, 0.0, 40.0, 40.0)), 0.5, 1.0))
    assert tuple(k) == (20.0, 20.0, 40.0, 80.0)
    m = one(spark, poses.warp_matrix(F.lit(20.0), F.lit(20.0), F.lit(40.0), F.lit(90.0), 80.0, 160.0))
    assert [m.a * 20 + m.b * 20 + m.c, m.d * 20 + m.e * 20 + m.f] == pytest.approx([40, 80])
    # A quarter turn: what lies to the right of the centre comes to lie above the middle.
    assert [m.a * 40 + m.b * 20 + m.c, m.d * 40 + m.e * 20 + m.f] == pytest.approx([40, 40])
