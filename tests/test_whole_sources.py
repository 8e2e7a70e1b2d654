"""Images drawn anew read their sources from one row for each image; samples and pixels are not shuffled, and the result is that of a join by pixel."""

import re

import pytest
from pyspark.sql import functions as F

from brindle.catalogue import REGISTRY
from brindle.operators import transforms
from brindle.operators.transforms import Affine

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["turned_images", "image_extents_bilinear", "image_extents_nearest"])
def test_no_exchange_of_samples(spark, name):
    plan = REGISTRY.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all(re.fullmatch(r"image_id#\d+L, \d+", d) for d in dealt)
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


@pytest.mark.parametrize("method, border", [("bilinear", "blend"), ("bilinear", "repeat"), ("nearest", "blend"), ("nearest", "repeat")])
def test_rows_and_pixels(spark, monkeypatch, method, border):
    """Pixels that are missing, null, there twice or outside, an image without pixels, and one whose transform is null."""
    h, w = 4, 5
    cells = [(i, y, x, (i * 31 + y * 7 + x * 5) % 11 / 10) for i in range(4) for y in range(h) for x in range(w)]
    cells = [c for c in cells if c[:3] not in {(1, 0, 0), (1, 0, 1), (1, 2, 3), (1, 3, 4)} and c[0] != 3]
    cells = [(*c[:3], None) if c[:3] == (2, 1, 1) else c for c in cells] + [(2, 0, 3, 0.5), (0, -1, 2, 9.0), (0, 2, w, 9.0)]
    pixels = spark.createDataFrame(cells, "image_id long, y int, x int, value double")
    images = spark.createDataFrame([(0, 0.3, 6, 7), (1, -0.4, 5, 5), (2, 1.1, 1, 9), (3, 0.2, 3, 2), (4, None, 2, 3)], "image_id long, a double, h int, w int")
    back = Affine.of(F.cos("a"), F.sin("a"), 0.3, -F.sin("a"), F.cos("a"), -0.2)
    got = {}
    for most in (transforms.WHOLE, 0):
        monkeypatch.setattr(transforms, "WHOLE", most)
        made = transforms.warp(pixels, images, (h, w), back, F.col("h"), F.col("w"), method, border, 0.25)
        got[most] = {(r.image_id, r.y, r.x): r.value for r in made.collect()}
    whole, parted = got.values()
    assert whole.keys() == parted.keys() and len(whole) == 42 + 25 + 9 + 6 + 6
    assert all(abs(whole[k] - parted[k]) < 1e-12 for k in whole)
    assert any(v not in (0.25,) for v in whole.values()) and all(v == 0.25 for k, v in whole.items() if k[0] == 4)
