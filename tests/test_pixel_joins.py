"""Tables of pixels are never sent to all executors: what explode makes looks small to the planner, and is not."""

import pytest
from pyspark.sql import functions as F

from brindle.catalogue import REGISTRY
from brindle.operators import masks

SF = "/root/testdata/sf0.001"
NAMES = [
    "image_blend_compare", "fill_holes", "grown_instances", "agnostic_fill", "image_extents_bilinear", "image_extents_nearest", "largest_region", "remove_small_regions",
    "mask_aspect_crop", "mask_aspect_pad", "mask_aspect_stretch", "resize_by_mask_crop", "resize_by_mask_pad", "resize_by_mask_lanczos4", "turned_images", "resize_pad", "mask_properties",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_pixels_are_broadcast(spark, name):
    plan = REGISTRY.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    # The weights of lanczos4 depend on the sizes that occur, not on the pixels.
    assert all("__size" in line for line in sent) if name.endswith("lanczos4") else not sent


@pytest.mark.parametrize("name", ["arg_max_label", "mask_gaussian", "image_blend_compare"])
def test_images_are_dealt_before_they_are_spread_out(spark, name):
    plan = REGISTRY.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("Generate")[-1]


def test_gaussian_wider_than_the_image(spark):
    """A window that is mirrored more than once, against a plain loop."""
    from math import exp

    h, w, sigma = 2, 3, 2.0
    cells = [(0, y, x, float((x * 7 + y * 5) % 4)) for y in range(h) for x in range(w)]
    got = {(r.y, r.x): r.value for r in masks.gaussian(spark.createDataFrame(cells, "image_id long, y int, x int, value double"), sigma).collect()}
    weights = {k: exp(-0.5 * (k / sigma) ** 2) for k in range(-8, 9)}
    mirror = lambda t, n: t % (2 * n) if t % (2 * n) < n else 2 * n - 1 - t % (2 * n)
    value, total = {(y, x): v for _, y, x, v in cells}, sum(weights.values())
    want = {(y, x): sum(value[mirror(y + i, h), mirror(x + j, w)] * a * b for i, a in weights.items() for j, b in weights.items()) / total**2 for y in range(h) for x in range(w)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gaussian_has_no_search_for_targets(spark):
    made = masks.gaussian(spark.range(4).select(F.lit(0).alias("image_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), F.lit(1.0).alias("value")), 1.0)
    assert "filter(transform" not in made._jdf.queryExecution().executedPlan().toString()
