"""Rotated boxes, regions, layouts and running sums on cases that are easy to work out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import datasets, layouts, masks, metrics, regions, resizing, rotated


def test_rotated_overlap():
    square = np.array([0.0, 0.0, 1.0, 1.0, 0.0])
    others = np.array([[0, 0, 1, 1, 45], [0, 0, 1, 1, 90], [0.5, 0, 1, 1, 0], [2, 0, 1, 1, 30], [0, 0, 0.5, 0.5, 20], [0, 0, 0, 0, 0]], float)
    shared = 2 * (2**0.5 - 1)
    assert rotated.rotated_iou(square, others) == pytest.approx([shared / (2 - shared), 1.0, 1 / 3, 0.0, 0.25, 0.0])
    draw = np.random.default_rng(1)
    boxes = np.column_stack([draw.uniform(0, 10, (60, 2)), draw.uniform(1, 6, (60, 2)), draw.uniform(-180, 180, 60)])
    spots = draw.uniform(-5, 15, (200_000, 2))

    def inside(b):
        t = np.radians(b[4])
        d = spots - b[:2]
        return (np.abs(d[:, 0] * np.cos(t) - d[:, 1] * np.sin(t)) <= b[2] / 2) & (np.abs(d[:, 0] * np.sin(t) + d[:, 1] * np.cos(t)) <= b[3] / 2)

    first = inside(boxes[0])
    for b, got in zip(boxes[1:], rotated.rotated_iou(boxes[0], boxes[1:])):
        other = inside(b)
        assert got == pytest.approx((first & other).sum() / (first | other).sum(), abs=0.03)


def picture(spark, rows):
    return spark.createDataFrame([(0, y, x, float(c == "#")) for y, line in enumerate(rows) for x, c in enumerate(line)], "image_id long, y int, x int, value double")


def shown(df, h, w):
    on = {(r.y, r.x) for r in df.filter("value > 0.5").collect()}
    return ["".join("#" if (y, x) in on else "." for x in range(w)) for y in range(h)]


def test_regions(spark):
    p = picture(spark, ["##...#", "#..#.#", "..#..#", "......", "###...", "#.#.#.", "###..."])
    assert sorted(r.area for r in regions.boxes_of(regions.regions(p)).collect()) == [1, 2, 3, 3, 8]
    assert shown(regions.largest(p), 7, 6)[4:] == ["###...", "#.#...", "###..."]
    assert shown(regions.fill_holes(p), 7, 6)[5] == "###.#."
    assert shown(regions.remove_small(p, 3), 7, 6)[:3] == ["##...#", "#....#", ".....#"]


def test_morphology_borders(spark):
    p = picture(spark, ["####", "####", "####"])
    assert shown(masks.morphology(p, -3, 0), 3, 4) == [".##."] * 3
    assert shown(masks.morphology(p, -2, 0), 3, 4) == [".###"] * 3
    one = picture(spark, ["....", ".#..", "...."])
    assert shown(masks.morphology(one, 2, 0), 3, 4)[1] == "##.."


def test_layouts_and_resizing(spark):
    row = spark.range(1)
    with pytest.raises(ValueError, match="four numbers"):
        layouts.custom("1 2 3", F.lit(10), F.lit(10))
    with pytest.raises(ValueError, match="empty"):
        layouts.custom("# nothing", F.lit(10), F.lit(10))
    slots = row.select(layouts.grid(F.lit(10), F.lit(7), 3, 2).alias("s")).first().s
    assert [tuple(x) for x in slots] == [(0, 0, 3, 3), (3, 0, 3, 3), (6, 0, 4, 3), (0, 3, 3, 4), (3, 3, 3, 4), (6, 3, 4, 4)]
    p = picture(spark, ["#.", ".#"])
    assert shown(resizing.resize(p, (2, 2), (2, 4), "pad"), 2, 4) == [".#..", "..#."]
    assert shown(resizing.resize(p, (2, 2), (4, 4)), 4, 4) == ["##..", "##..", "..##", "..##"]


def test_running_sums_over_ranges(spark):
    random.seed(2)
    rows = [(random.choice("aaaab"), random.random(), random.randrange(5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, v int").repartition(7)
    made = metrics.running_sums(df, ["g"], [F.desc("s")], {"t": F.col("v").cast("long"), "n": F.lit(1).cast("long")})
    high = metrics.running_max_from_end(made, ["g"], "n", "v", "m")
    got = {(r.g, r.s): (r.t, r.n, r.m) for r in high.collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        total = 0
        for k, (_, s, v) in enumerate(mine):
            total += v
            assert got[g, s] == (total, k + 1, max(x[2] for x in mine[k:]))


def test_duplicate_annotation_ids_fail(spark):
    notes = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    with pytest.raises(Exception, match="occurs twice: 2"):
        datasets._assert_unique(notes, "id").collect()
