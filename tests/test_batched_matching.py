"""Matching reads its groups from large batches, both sides in one table, with no call for each group and no group's pairs held whole."""

import random

import numpy as np
import pytest

from brindle.catalogue import REGISTRY
from brindle.operators import matching

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["greedy_detection_match", "coco_matching", "voc_matching", "box_recall"])
def test_one_pass_and_no_call_for_each_group(spark, name):
    text = plan(REGISTRY.queries()[name](spark, SF))
    assert "MapInArrow" in text and "CoGroup" not in text and text.count("Scan parquet") == 1


def plain(found, goals, threshold, strict):
    rows = []
    for image in {d[0] for d in found}:
        free = sorted((g for g in goals if g[0] == image), key=lambda g: g[1])
        for d in sorted((d for d in found if d[0] == image), key=lambda d: (-d[2], d[1])):
            best, most = None, -1.0
            for g in free:
                w, h = min(d[5], g[4]) - max(d[3], g[2]), min(d[6], g[5]) - max(d[4], g[3])
                both = max(w, 0) * max(h, 0)
                over = both / ((d[5] - d[3]) * (d[6] - d[4]) + (g[4] - g[2]) * (g[5] - g[3]) - both)
                if over > most:
                    best, most = g, over
            hit = best is not None and (most > threshold if strict else most >= threshold)
            if hit:
                free.remove(best)
            rows.append((image, d[1], best[1] if hit else None, most if hit else 0.0, hit))
    return rows


@pytest.mark.parametrize("threshold, strict", [(0.3, False), (0.0, False), (0.0, True), (0.5, True)])
def test_greedy_match_against_a_loop(spark, threshold, strict):
    """Also where groups span batches and where one side is missing."""
    draw = random.Random(5)
    box = lambda: (lambda x, y: (x, y, x + draw.randint(1, 9), y + draw.randint(1, 9)))(draw.randint(0, 9), draw.randint(0, 9))
    found = [(i, k, draw.randint(1, 4) / 4, *map(float, box())) for i in range(6) if i != 2 for k in range(40)]
    goals = [(i, k, *map(float, box())) for i in range(6) if i != 4 for k in range(30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        shown = spark.createDataFrame(found, "image long, det_id long, score double, x0 double, y0 double, x1 double, y1 double")
        truth = spark.createDataFrame(goals, "image long, gt_id long, x0 double, y0 double, x1 double, y1 double")
        got = matching.greedy_match(shown, truth, ["image"], threshold, ["det_id"], strict).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.image, r.det_id, r.gt_id, r.iou, r.hit) for r in got) == sorted(plain(found, goals, threshold, strict))


def test_blocks_of_a_large_group(monkeypatch):
    """A group whose pairs are not held at once comes to the same matches."""
    draw = np.random.default_rng(6)
    low = draw.integers(0, 9, (300, 2)).astype(float)
    boxes = np.hstack([low, low + draw.integers(1, 9, (300, 2))])

    def matches():
        blocks = matching.overlap_blocks(boxes, [0, 300], np.array([140]), lambda a, b: matching._overlaps(a, b, 0.0))
        free, shared, goal, parts = np.ones(300, bool), np.arange(300) % 17 == 0, {}, 0
        for d, t, _ in matching.links(blocks, 0.3):
            got = matching.taken(d, t, free, shared)
            free[t[got]], parts = shared[t[got]], parts + 1
            goal |= dict(zip(d[got].tolist(), t[got].tolist()))
        return goal, parts

    whole, one = matches()
    monkeypatch.setattr(matching, "LINKS", 50)
    monkeypatch.setattr(matching, "COMPARED", 700)
    blocks, many = matches()
    assert blocks == whole and one == 1 and many > 5 and len(whole) > 100


@pytest.mark.parametrize("points", [None, 11])
def test_average_precision_of_categories_that_span_ranges(spark, points):
    """Marks are checkpointed once, narrow, and nothing is shuffled after that but sums; ranges and one range come to the same."""
    from brindle.operators import evaluation
    from brindle.plans.evaluation import TEN, both

    made, plans = [], []
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            df = evaluation.voc_average_precision_of(both(spark, SF), "image", "label", TEN, points)
            plans.append(plan(df))
            made.append({(r.label, r.threshold): r.ap for r in df.collect()})
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made[0]) == 30 and made[1] == pytest.approx(made[0])
    assert all("Sort " not in p and "Window" not in p for p in plans)


def test_marks_of_null_groups_and_nan(spark):
    """No truth of an unknown group is met, as a join by it would have it; the group stays in the curve without a hit."""
    from brindle.operators import evaluation

    found = spark.createDataFrame([(None, 1, 0.5, 0.0, 0.0, 2.0, 2.0), ("a", 2, 0.5, 0.0, 0.0, 2.0, 2.0)], "label string, det_id long, score double, x0 double, y0 double, x1 double, y1 double").selectExpr("1 AS image", "*")
    goals = spark.createDataFrame([(None, 1, False, 0.0, 0.0, 2.0, 2.0), ("a", 2, None, 0.0, 0.0, 2.0, 2.0), ("b", 3, True, 0.0, 0.0, 2.0, 2.0)], "label string, gt_id long, difficult boolean, x0 double, y0 double, x1 double, y1 double").selectExpr("1 AS image", "*")
    marks = {r.label: (r.tp, r.fp) for r in evaluation.voc_marks(found, goals, ["image", "label"], [0.5]).collect()}
    assert marks == {None: ([False], [True]), "a": ([True], [False])}
    got = {r.label: r.ap for r in evaluation.voc_average_precision(found, goals, "image", "label", [0.5]).collect()}
    assert got == {None: 0.0, "a": 1.0, "b": 0.0}
