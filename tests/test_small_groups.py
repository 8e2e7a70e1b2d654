"""Many small groups pass a task in batches: no call and no table for each of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.catalogue import REGISTRY
from brindle.operators import matching, rotated

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["global_greedy_match", "rotated_nms", "nms_per_class", "detections_per_image"])
def test_no_call_for_each_group(spark, name):
    plan = REGISTRY.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_groups_larger_and_smaller_than_a_batch(spark):
    """One group spans several batches; a null key is a group like others, and rows without a score come last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(300).select(F.when(F.col("id") < 100, None).when(F.col("id") < 250, 1).otherwise(F.col("id")).alias("g"), "id", F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("double")).alias("s"))
        kept = matching.pick(rows, ["g"], [*matching.falling("s"), "id"], ["id"], lambda v: np.array([0, len(v) - 1])[: len(v)]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {}
    for r in kept:
        found.setdefault(r.g, []).append(r.id)
    assert found.pop(None) == [4, 95] and found.pop(1) == [104, 245]
    assert found == {k: [k] for k in range(250, 300)} or found == {k: [k, k] for k in range(250, 300)}


@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5])
def test_rotated_pairs_against_one_by_one(threshold):
    draw = np.random.default_rng(3)
    boxes = np.column_stack([draw.uniform(0, 30, (120, 2)), draw.uniform(-1, 12, (120, 2)), draw.uniform(-180, 180, 120)])
    order, want = np.arange(len(boxes)), []
    while len(order):
        want.append(order[0])
        order = order[1:][rotated.rotated_iou(boxes[order[0]], boxes[order[1:]]) <= threshold]
    assert matching.first_come(rotated._beyond(boxes, threshold)).tolist() == want


def test_masks_by_row_and_by_pixel(spark):
    """Masks given as arrays and as pixels are the same, also where an image spans batches; sets are not put together anew for each image."""
    draw = np.random.default_rng(5)
    masks = [(k // 30, k % 30, float(draw.integers(0, 5)) / 10, sorted({int(p) for p in draw.integers(0, 60, 9)})) for k in range(90)]
    rows = spark.createDataFrame(masks, "image long, mask_id long, score double, pixels array<long>")
    want = set()
    for image in range(3):
        taken = set()
        for _, m, s, mine in sorted((r for r in masks if r[0] == image), key=lambda r: (-r[2], r[1])):
            if s >= 0.1 and len(taken & set(mine)) / len(mine) <= 0.5:
                want |= {(image, m, s, p) for p in set(mine) - taken}
                taken |= set(mine)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for given in (rows, rows.select("image", "mask_id", "score", F.explode("pixels").alias("pixel"))):
            made = matching.mask_suppression(given, "image", 0.5, 0.1)
            assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
            assert {tuple(r) for r in made.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
